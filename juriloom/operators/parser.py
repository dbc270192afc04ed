"""The hierarchical parse: lines of a document to a tree of nodes.

A document is read line by line with the latest open node of each kind, so it is one call for each document; documents
are independent, so the parse is a map over rows without a shuffle. Rules are tried in the order of ``RULES``.
"""
from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id string, node_id string, node_type string, label string, text string, parent_id string, order_index int, level int, article string, clause string, point string, path_title string"
FIELDS = [x.split() for x in SCHEMA.split(", ")]
# How structural lines look, on the line or on its key (lower case, no accents).
ARTICLE = re.compile(r"^dieu\s+(\d+[a-z]?)(?:[.:;\-)]?\s*(.*))?$")
SECTION = re.compile(r"^(phan|chuong|muc|tieu muc)\b")
ROMAN = re.compile(r"^([IVXLCDM]{1,8})[.)]\s+(.+)$")
ALPHA = re.compile(r"^([A-Z])[.)]\s+(.+)$")
DECIMAL = re.compile(r"^(\d+(?:\.\d+)+)\.?\s+(.+)$")
NUMBERED = re.compile(r"^(\d+)\.\s+(.+)$")
POINT = re.compile(r"^([a-zđ])\)\s+(.+)$", re.IGNORECASE)
LISTED = re.compile(r"^(?:(\d+)\)|\(([a-zđ]|[ivxlcdm]{1,8}|\d{1,3})\))\s+(.+)$", re.IGNORECASE)
BULLET = re.compile(r"^[-+*•]\s+(.+)$")
INLINE_DECIMAL = re.compile(r"\s+(?=\d+(?:\.\d+)+\.?\s+)")
FOOTER_STARTS = ("noi nhan", "tm.", "kt.", "tl.", "tuq.", "thu ky", "nguoi ky", "- luu:", "+ luu:", "luu:")
FOOTER_ROLES = {"bo truong", "thu truong", "thu tuong", "pho thu tuong", "chu tich", "pho chu tich", "giam doc", "tong giam doc"}
NOT_TABLES = ("so:", "so ", "cong hoa", "doc lap", "noi nhan", "luu:")
ATTACHMENTS = {"de an", "ke hoach", "chuong trinh"}
BELOW_ARTICLE = ("article", "clause", "point", "item", "roman", "alpha", "table")


def key_of(text: str) -> str:
    bare = "".join(c for c in unicodedata.normalize("NFD", " ".join(text.split())) if unicodedata.category(c) != "Mn")
    return bare.replace("đ", "d").replace("Đ", "D").lower()


def is_table(line: str) -> bool:
    cells = [c.strip() for c in line.split("|") if c.strip()] if "|" in line else []
    return len(cells) >= 2 and not key_of(" ".join(cells[:2])).startswith(NOT_TABLES)


def clean_lines(text: str) -> Iterator[str]:
    """Collapsed lines; a numbered line that runs on into decimals is taken apart."""
    for raw in (text or "").replace("﻿", " ").splitlines():
        line = " ".join(raw.split())
        if not line:
            continue
        parts = INLINE_DECIMAL.split(line) if NUMBERED.match(line) and not is_table(line) else [line]
        yield from parts if len(parts) > 1 and all(DECIMAL.match(p) for p in parts[1:]) else [line]


class _Tree:
    """Nodes in order of creation, and the latest open one of each kind."""

    def __init__(self, doc_id: str, title: str):
        self.doc_id, self.nodes, self.open, self.by_id, self.rows = doc_id, [], {}, {}, 0
        self.root = self.add("document", title, title, None)

    def add(self, kind: str, label: str, text: str, parent: dict | None, **refs: str) -> dict:
        order = len(self.nodes)
        inherited = {k: parent[k] if parent else None for k in ("article", "clause", "point")} | refs
        node = {
            "doc_id": self.doc_id, "node_id": f"{self.doc_id}::{kind}::{order:06d}", "node_type": kind, "label": label, "text": text, "parent_id": parent and parent["node_id"], "order_index": order,
            "level": parent["level"] + 1 if parent else 0, "path_title": "" if not parent else " > ".join(x for x in (parent["path_title"], label) if x), **inherited,
        }
        self.nodes.append(node)
        self.by_id[node["node_id"]] = node
        return node

    def latest(self, *kinds: str) -> dict:
        return next((self.open[k] for k in kinds if k in self.open), self.root)

    def close(self, *kinds: str) -> None:
        for k in kinds:
            self.open.pop(k, None)


def parse(doc_id: str, text: str, title: str = "") -> list[dict]:
    tree = _Tree(doc_id, title or doc_id)
    footer, before_was_table, last = False, False, tree.root
    for line in clean_lines(text):
        key = key_of(line)
        restart = bool(key.startswith("phu luc") or SECTION.match(key) or ARTICLE.match(key))
        if footer and not (restart or is_table(line)):
            continue
        footer = False
        if key.strip(" :-").startswith(FOOTER_STARTS) or key.strip(" :-") in FOOTER_ROLES:
            footer = True
            continue
        was_table, before_was_table = before_was_table, False
        node = _structural(tree, line, key)
        if node is None and is_table(line):
            node, before_was_table = _table_row(tree, line, was_table), True
        node = node or _listed(tree, line)
        if node:
            last = node
        else:
            last["text"] = f"{last['text']} {line}".strip()
    return tree.nodes


def _structural(tree: _Tree, line: str, key: str) -> dict | None:
    """Appendix, attachment, section, article, roman or lettered section."""
    o = tree.open
    if key.startswith("phu luc") or key in ATTACHMENTS:
        o.clear()
        kind = "appendix" if key.startswith("phu luc") else "attachment"
        o["section"] = node = tree.add(kind, line, line, tree.root)
        if kind == "appendix":
            o["appendix"] = node
        return node
    if SECTION.match(key):
        tree.close(*BELOW_ARTICLE)
        o["section"] = node = tree.add("section", line, line, tree.latest("appendix"))
        return node
    if m := ARTICLE.match(key):
        tree.close("clause", "point", "item")
        o["article"] = node = tree.add("article", f"Điều {m[1]}", line, tree.latest("appendix"), article=f"Điều {m[1]}", clause=None, point=None)
        return node
    inside = "article" in o and "appendix" not in o
    if (m := ROMAN.match(line)) and not inside:
        tree.close(*BELOW_ARTICLE[:4])
        parent = tree.by_id.get(o["alpha"]["parent_id"]) if "alpha" in o else None
        parent = parent or tree.latest("section", "appendix")
        tree.close("alpha", "table")
        o["roman"] = node = tree.add("roman_section", f"{m[1]}.", line, parent)
        return node
    if (m := ALPHA.match(line)) and not inside and ("appendix" in o or len(key_of(m[2])) >= 8):
        tree.close(*BELOW_ARTICLE[:4], "table")
        o["alpha"] = node = tree.add("alpha_section", f"{m[1]}.", line, tree.latest("roman", "section", "appendix"))
        return node
    return None


def _table_row(tree: _Tree, line: str, was_table: bool) -> dict:
    parent = tree.latest("point", "clause", "item", "article", "appendix", "section")
    table = tree.open.get("table")
    if not was_table or table is None or table["parent_id"] != parent["node_id"]:
        tree.open["table"] = table = tree.add("table", "Bảng", "", parent)
        tree.rows = 0
    tree.rows += 1
    return tree.add("table_row", f"Dòng bảng {tree.rows}", line, table)


def _listed(tree: _Tree, line: str) -> dict | None:
    """Decimal item, clause, item, point, list item or bullet."""
    o = tree.open
    if m := DECIMAL.match(line):
        parent = tree.latest("item", "alpha", "roman", "section", "appendix")
        tree.close("clause", "point")
        o["item"] = node = tree.add("decimal_item", m[1], line, parent)
        return node
    if m := NUMBERED.match(line):
        if "article" in o:
            tree.close("point", "item")
            o["clause"] = node = tree.add("clause", f"Khoản {m[1]}", line, o["article"], clause=f"Khoản {m[1]}", point=None)
        else:
            tree.close("clause", "point")
            o["item"] = node = tree.add("item", f"{m[1]}.", line, tree.latest("alpha", "roman", "section", "appendix"))
        return node
    if (m := POINT.match(line)) and ("clause" in o or "item" in o):
        o["point"] = node = tree.add("point", f"Điểm {m[1].lower()}", line, tree.latest("clause", "item"), point=f"Điểm {m[1].lower()}")
        return node
    if m := LISTED.match(line):
        node = tree.add("list_item", m[1] or m[2], line, tree.latest("point", "clause", "item", "article", "alpha", "roman", "section"))
        if "article" not in o:
            o["item"] = node
        return node
    if BULLET.match(line):
        return tree.add("bullet", "-", line, tree.latest("point", "clause", "item", "article", "alpha", "roman", "section"))
    return None


def parsed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", title: str | None = None) -> DataFrame:
    """The nodes of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "int": pa.int32()}
        for batch in batches:
            for d, t, h in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "title")), strict=True):
                nodes = parse(d, t, h)
                yield pa.RecordBatch.from_arrays([pa.array([n[name] for n in nodes], kinds[kind]) for name, kind in FIELDS], names=[name for name, _ in FIELDS])

    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"), (F.col(title) if title else F.lit("")).alias("title"))
    return rows.mapInArrow(run, SCHEMA)
