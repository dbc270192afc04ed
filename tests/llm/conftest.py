import sys
from pathlib import Path

for place in (Path(__file__).parent, Path(__file__).parent.parent):
    sys.path.insert(0, str(place))
