"""Collection configurations: ``KEY value`` lines and ``ATTRIBUTE name { ... }`` / ``STRUCTURE name { ... }`` blocks.

Values are bare words or quoted by " or '. ``#`` begins a comment line. Names may repeat; the last one holds.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path

#: The type names a column may have and how a reader takes it; others can be written but not opened.
READABLE = {**dict.fromkeys(("MD_MD", "FD_FD", "FD_MD"), "delta"), **dict.fromkeys(("MD_MGD", "FD_FGD", "FD_MGD"), "giga"), "Int": "int"}
WRITABLE = {**READABLE, "MD_MI": "int", "NoMem": "giga"}
DEFAULT_VALUE = "===NONE==="
#: Folders with configurations, separated by colons; REGISTRY_FALLBACK comes last.
REGISTRY_VARIABLE = "CORPUS_REGISTRY"
REGISTRY_FALLBACK = ("/corpora/registry/",)


class AttributeNotFound(LookupError):
    """The configuration has no such attribute or structure, or it can't be opened."""


@dataclass
class Block:
    """Values, attributes and structures of a configuration or of one of its blocks."""

    values: dict[str, str] = field(default_factory=dict)
    attributes: dict[str, Block] = field(default_factory=dict)
    structures: dict[str, Block] = field(default_factory=dict)

    def value(self, key: str) -> str | None:
        return self.values.get(key)


def _pieces(line: str) -> list[str]:
    out, at = [], 0
    while at < len(line):
        c = line[at]
        if c.isspace():
            at += 1
        elif c in "{}":
            out.append(c)
            at += 1
        elif c in "\"'":
            end = line.find(c, at + 1)
            if end < 0:
                raise ValueError(f"unterminated quote: {line!r}")
            out.append("=" + line[at + 1 : end])
            at = end + 1
        else:
            end = at
            while end < len(line) and not line[end].isspace() and line[end] not in "{}":
                end += 1
            out.append("=" + line[at:end])
            at = end
    return out


def parse(text: str) -> Block:
    """The tree of a configuration text."""
    stack = [Block()]
    pending: Block | None = None
    for line in text.splitlines():
        if line.lstrip().startswith("#"):
            continue
        words: list[str] = []
        for piece in [*_pieces(line), "\n"]:
            if piece.startswith("="):
                words.append(piece[1:])
                continue
            if words:
                key, name = words[0], words[1] if len(words) > 1 else ""
                if key in ("ATTRIBUTE", "STRUCTURE"):
                    pending = Block()
                    (stack[-1].attributes if key == "ATTRIBUTE" else stack[-1].structures)[name] = pending
                else:
                    stack[-1].values[key] = name
                words = []
            if piece == "{":
                stack.append(pending or Block())
                pending = None
            elif piece == "}":
                if len(stack) == 1:
                    raise ValueError("closing brace without a block")
                stack.pop()
    if len(stack) > 1:
        raise ValueError("block without closing brace")
    return stack[0]


def find(name: str) -> str:
    """Path of a configuration: a path if it begins with . or /, else the first hit in the registry folders."""
    if name.startswith((".", "/")):
        return name
    for folder in [*filter(None, os.environ.get(REGISTRY_VARIABLE, "").split(":")), *REGISTRY_FALLBACK]:
        if (path := Path(folder) / name).is_file():
            return str(path)
    raise FileNotFoundError(f"no configuration {name!r} in the registry")


def rebased(config: str, path: str) -> str:
    """A path that begins with . is relative to the folder of the configuration; others are as they are."""
    return str(Path(config).resolve().parent / path) if path.startswith(".") else path


@dataclass
class Config:
    """A configuration, where it was read, and the folder of its data."""

    name: str
    tree: Block
    path: str

    @classmethod
    def open(cls, name: str) -> Config:
        file = find(name)
        return cls.of(Path(file).read_text(encoding="utf-8"), file)

    @classmethod
    def of(cls, text: str, name: str = "./config") -> Config:
        tree = parse(text)
        path = tree.value("PATH")
        if path is None:
            raise AttributeNotFound("PATH")
        return cls(name, tree, rebased(name, path).rstrip("/") + "/")

    def get(self, key: str) -> str | None:
        """A value with its default; an empty value counts as unset."""
        if have := self.tree.value(key):
            return have
        if key == "DEFAULTATTR":
            return "word"
        if key == "WSATTR":
            return next((a for a in ("lempos_lc", "lempos", "lemma_lc", "lemma") if a in self.tree.attributes), None) or self.get("DEFAULTATTR")
        if key == "WSBASE":
            return rebased(self.name, f"{self.path}{self.get('WSATTR')}-ws")
        return None

    def segment_size(self) -> int:
        """Granularity of seeks; it has no effect on results."""
        have = self.tree.value("SEGMENTSIZE") or ""
        return int(have) if have.isdigit() else 128

    def positional(self) -> list[tuple[str, str]]:
        """(name, default value) of the attributes that input columns stand for, in order."""
        return [(n, b.value("DEFAULTVALUE") or DEFAULT_VALUE if b.value("DEFAULTVALUE") != "" else "") for n, b in self.tree.attributes.items() if b.value("DYNAMIC") is None]

    def structures(self) -> dict[str, list[tuple[str, str]]]:
        """For each structure its (attribute, default value), dynamic ones included."""
        return {s: [(n, v if (v := b.value("DEFAULTVALUE")) is not None else DEFAULT_VALUE) for n, b in block.attributes.items()] for s, block in self.tree.structures.items()}

    def attribute(self, name: str) -> Block:
        """The block of an attribute ``a`` or of a structure's attribute ``s.a``."""
        head, dot, tail = name.partition(".")
        owner = self.tree.structures.get(head) if dot else self.tree
        block = owner.attributes.get(tail.split(".")[0] if dot else head) if owner else None
        if block is None:
            raise AttributeNotFound(name)
        return block

    def source_of(self, name: str) -> str | None:
        """The attribute that a dynamic one derives from, None for others."""
        block = self.attribute(name)
        if block.value("DYNAMIC") is None:
            return None
        if block.value("FROMATTR") is None:
            raise AttributeNotFound(f"FROMATTR of {name}")
        return (name.partition(".")[0] + "." if "." in name else "") + block.value("FROMATTR")

    def reader(self, name: str) -> str:
        """How an attribute's column is read; a type that no reader takes can't be opened."""
        kind = self.attribute(name).value("TYPE") or ("Int" if "." in name else "MD_MD")
        if kind not in READABLE:
            raise AttributeNotFound(f"{name}: type {kind}")
        return READABLE[kind]

    def wide(self, structure: str) -> bool:
        """Whether a structure's ranges are declared as 64 bits; they are BIGINT in any case."""
        if structure not in self.tree.structures:
            raise AttributeNotFound(structure)
        return self.tree.structures[structure].value("TYPE") in ("file64", "map64")
