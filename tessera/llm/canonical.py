"""Problem 9: one form for texts that look the same, by vocabulary tries and a weighted edit automaton.

A text is cut into words and what lies between them. The characters of a word drive a weighted
edit automaton through a trie of vocabulary words: look-alike letters match at no cost,
ignorable characters are deleted at no cost, composed letters, ligatures and width forms are
read as the characters they stand for, and any other edit costs 1. With a budget of 0 the words
reached are the vocabulary's spellings of what the word looks like; the canonical spelling is
the most frequent of them (lowest rank). A word without such a spelling, and everything between
words, is normalised by table.

Looking the same is a matter of look-alike classes, so it is an equivalence: words of one class
reach the same vocabulary words, and the table writes a class in the first script that has all
its letters. Two texts therefore have equal canonical forms if and only if they read the same.

The vocabulary is that of a public tokenizer: a file of fixed size, a parameter, loaded once per
Python worker; nothing about the corpus is collected or broadcast. Texts run through in Arrow
batches, whole, and are cut at blanks; what stands between two blanks is worked once and kept in a bounded
cache, which changes no result: a blank is no part of a word and joins with nothing.

Defined results: NULL stays NULL and empty stays empty; neither is in a pair (equal code points
are no case). Case, accents, punctuation, digits, raised digits and the number of blanks are
visible. A NULL doc_id is in no pair; repeated rows with one doc_id are one document per text.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.tokens import TOKENIZERS, VOCABULARY
from tessera.session import cut, discard

# Letters of the same shape, as Latin, Greek, Cyrillic ('-' where a script has none).
SAME_SHAPE = """
A Α А | B Β В | C Ϲ С | E Ε Е | H Η Н | I Ι І | J Ϳ Ј | K Κ К | M Μ М | N Ν - | O Ο О | P Ρ Р | Q - Ԛ | S - Ѕ
T Τ Т | W - Ԝ | X Χ Х | Y Υ Ү | Z Ζ - | - Γ Г | - Π П | - Φ Ф | - Θ Ѳ
a - а | c ϲ с | d - ԁ | e - е | h - һ | i - і | j ϳ ј | l - ӏ | o ο о | p - р | q - ԛ | s - ѕ | v ν ѵ | w - ԝ | x - х | y - у
æ - ӕ | Æ - Ӕ | ə - ә | Ə - Ә
"""

#: Visible format characters: numbers and marks of Arabic, Syriac and Kaithi.
VISIBLE_FORMATS = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD}
#: Ignorables that aren't of category Cf: grapheme joiner, Hangul fillers, Mongolian and other variation selectors, Khmer inherent vowels.
OTHER_IGNORABLES = {0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x17B4, 0x17B5, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}

#: Forms kept by a worker, and the longest part of a text kept.
CACHE_WORDS, CACHE_LENGTH = 200_000, 64
SCRIPTS = ("Latin", "Cyrillic", "Greek")


def _tables() -> tuple[dict[int, str], set[int], dict[str, dict[str, str]]]:
    """(characters read as others, ignorables, letter to its class by script), from the Unicode data by rule."""
    reads: dict[int, str] = {}
    ignorable = set(OTHER_IGNORABLES)
    for code in range(0x110000):
        c = chr(code)
        category = unicodedata.category(c)
        if category in ("Cn", "Co", "Cs"):
            continue
        if category == "Cf" and code not in VISIBLE_FORMATS:
            ignorable.add(code)
            continue
        if category == "Zs" or c == "\t":
            reads[code] = " "
            continue
        decomposed = unicodedata.decomposition(c)
        if decomposed.startswith("<"):
            tag, *parts = decomposed.split()
            name = unicodedata.name(c, "")
            digraph = 0x01C4 <= code <= 0x01CC or 0x01F1 <= code <= 0x01F3
            if tag in ("<wide>", "<narrow>") or digraph or (" LIGATURE " in name and "0020" not in parts):
                reads[code] = "".join(chr(int(p, 16)) for p in parts)
    reads = {k: "".join(reads.get(ord(x), x) for x in v) for k, v in reads.items() if k not in ignorable}
    classes: dict[str, dict[str, str]] = {}
    for cell in SAME_SHAPE.replace("\n", "|").split("|"):
        if cell.strip():
            latin, greek, cyrillic = cell.split()
            group = {s: x for s, x in zip(("Latin", "Greek", "Cyrillic"), (latin, greek, cyrillic)) if x != "-"}
            classes |= dict.fromkeys(group.values(), group)
    return reads, ignorable, classes


class Trie:
    """Vocabulary words by their decomposed characters; a node is [children by class, (rank, word) or None]."""

    def __init__(self, table: "Table"):
        self.table, self.root = table, [{}, None]

    def add(self, word: str, rank: int) -> None:
        node = self.root
        for unit in unicodedata.normalize("NFD", word):
            node = node[0].setdefault(self.table.class_of(unit), [{}, None])
        if node[1] is None or (rank, word) < node[1]:
            node[1] = (rank, word)

    def search(self, units: str, budget: int = 0) -> list[tuple[int, int, str]]:
        """(cost, rank, spelling) of the words within ``budget`` edits; look-alikes and ignorables cost nothing.

        The trie branches by look-alike class, so following one branch is following the edges of
        all letters of the shape; a node keeps the most frequent of the spellings that end there.
        """
        states = self._open({id(self.root): (0, self.root)}, budget)
        for unit in units:
            after: dict[int, tuple[int, list]] = {}
            free = ord(unit) in self.table.ignorable
            shape = self.table.class_of(unit)
            for cost, node in states.values():
                moves = [(cost if free else cost + 1, node)]
                if not free:
                    if shape in node[0]:
                        moves.append((cost, node[0][shape]))
                    if cost < budget:
                        moves += [(cost + 1, child) for k, child in node[0].items() if k != shape]
                for c, n in moves:
                    if c <= budget and (id(n) not in after or c < after[id(n)][0]):
                        after[id(n)] = (c, n)
            states = self._open(after, budget)
            if not states:
                return []
        return sorted((cost, *node[1]) for cost, node in states.values() if node[1])

    @staticmethod
    def _open(states: dict[int, tuple[int, list]], budget: int) -> dict[int, tuple[int, list]]:
        """With the states reached by inserting vocabulary characters."""
        waiting = list(states.values())
        while waiting:
            cost, node = waiting.pop()
            if cost < budget:
                for child in node[0].values():
                    if id(child) not in states or cost + 1 < states[id(child)][0]:
                        states[id(child)] = (cost + 1, child)
                        waiting.append((cost + 1, child))
        return states


class Table:
    """Normalisation by table; and the classes of look-alikes."""

    def __init__(self) -> None:
        self.reads, self.ignorable, self.classes = _tables()
        self.drop = dict.fromkeys(self.ignorable)
        self.both = self.reads | self.drop
        inside = "".join(regex.escape(chr(c)) for c in sorted(self.ignorable))
        self.words = regex.compile(rf"[\p{{L}}\p{{M}}{inside}]+")
        self.runs = regex.compile(rf"([{inside}])[{inside}]++")
        self.blocking = regex.compile(rf"[{inside}](?=\p{{M}})")
        self.script = {s: regex.compile(rf"[\p{{{s}}}\p{{M}}]+") for s in SCRIPTS}

    def class_of(self, unit: str) -> str:
        group = self.classes.get(unit)
        return next(iter(group.values())) if group else unit

    def units(self, word: str) -> str:
        """Decomposed characters of a word; of a run of ignorables one stays, and none that would block the order of accents."""
        return unicodedata.normalize("NFD", self.blocking.sub("", self.runs.sub(r"\1", word)).translate(self.reads))

    def spell(self, word: str) -> str:
        """A word's class in the first script that has all its letters; else each letter in its first script."""
        units = unicodedata.normalize("NFD", word.translate(self.both))
        for script in SCRIPTS:
            own = "".join(self.classes[u].get(script, u) if u in self.classes else u for u in units)
            if self.script[script].fullmatch(own):
                return unicodedata.normalize("NFC", own)
        return unicodedata.normalize("NFC", "".join(self.class_of(u) for u in units))


class Canonical(dict):
    """From a text to its canonical form; as a dictionary, from what stands between two blanks to its form."""

    def __init__(self, vocabulary: Iterable[tuple[str, int]]):
        super().__init__()
        self.table = Table()
        self.trie = Trie(self.table)
        for word, rank in vocabulary:
            if self._clean(word):
                self.trie.add(word, rank)

    def _clean(self, word: str) -> bool:
        """Fit to be a canonical spelling: composed, of one script, without forms that stand for others."""
        ok = word == unicodedata.normalize("NFC", word) and not any(ord(c) in self.table.both for c in word)
        return ok and bool(word) and any(r.fullmatch(unicodedata.normalize("NFD", word)) for r in self.table.script.values())

    def word(self, word: str) -> str:
        hits = self.trie.search(self.table.units(word))
        return hits[0][2] if hits else self.table.spell(word)

    def __missing__(self, part: str) -> str:
        out, end = [], 0
        for m in self.table.words.finditer(part):
            if m.start() > end:
                out.append(part[end : m.start()].translate(self.table.both))
            out.append(self.word(m[0]))
            end = m.end()
        out.append(part[end:].translate(self.table.both))
        form = "".join(out)
        if len(part) <= CACHE_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[part] = form
        return form

    def text(self, text: str) -> str:
        return unicodedata.normalize("NFC", " ".join(map(self.__getitem__, text.split(" "))))


def vocabulary_words(path: str) -> Iterator[tuple[str, int]]:
    """(word, rank) of a rank file: its tokens that are words, without the blank before them."""
    with open(path, "rb") as file:
        for line in file:
            token, rank = line.split()
            word = base64.b64decode(token).decode("utf-8", "ignore").removeprefix(" ")
            if len(word) > 1 and word.isalpha():
                yield word, int(rank)


_loaded: dict[str, Canonical] = {}


def canonicaliser(vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> Canonical:
    path = os.path.join(folder, vocabulary)
    if path not in _loaded:
        _loaded[path] = Canonical(vocabulary_words(path))
    return _loaded[path]


def canonical_text(text: str = "text", vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> Column:
    """The canonical form of a text column."""

    @F.pandas_udf("string")
    def canonical(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        form = canonicaliser(vocabulary, folder).text
        for part in parts:
            yield pd.Series([None if t is None else form(t) for t in part], dtype=object)

    return canonical(F.col(text))


def canonical_documents(documents: DataFrame, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, canonical): each document's text in its one form."""
    return documents.select("doc_id", canonical_text("text", vocabulary, folder).alias("canonical"))


def look_alikes(documents: DataFrame, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, class_id, variant): one row per document with a text; equal class means same look, equal variant same code points.

    Both are 128-bit digests, of the canonical form and of the text.
    """
    own = documents.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text", canonical_text("text", vocabulary, folder).alias("canonical"))
    return own.select("doc_id", F.md5("canonical").alias("class_id"), F.md5("text").alias("variant"))


def _linked_variants(rows: DataFrame) -> DataFrame:
    """(class_id, variant, n_docs, n_class) of the classes with several variants."""
    variants = rows.groupBy("class_id", "variant").agg(F.count("*").alias("n_docs"))
    classes = variants.groupBy("class_id").agg(F.count("*").alias("n_variants"), F.sum("n_docs").alias("n_class")).where("n_variants > 1")
    return variants.join(classes.drop("n_variants"), "class_id")


def look_alike_classes(documents: DataFrame, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """``look_alikes`` without repeated rows, with ``n_links``: how many documents of the class have another text.

    The counts are one row per variant of the classes that have several; the documents meet them by
    class and variant, so copies of one text, however many, are never paired.
    """
    rows = cut(look_alikes(documents, vocabulary, folder).distinct(), "forms")
    counts = _linked_variants(rows).select("class_id", "variant", (F.col("n_class") - F.col("n_docs")).alias("n_links"))
    return rows.join(counts, ["class_id", "variant"], "left").select("doc_id", "class_id", "variant", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def same_looking_pairs(documents: DataFrame, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: documents that differ in code points and look the same.

    Pairs are made between variants of a class, never between copies: the work is that of the
    rows that come out, however large a group of exact copies is.
    """
    rows = cut(look_alikes(documents, vocabulary, folder), "forms")
    several = _linked_variants(rows).select("class_id").distinct()
    kept = cut(rows.join(several, "class_id", "left_semi").distinct(), "forms")
    discard(rows)
    v = kept.select("class_id", "variant").distinct()
    links = v.alias("a").join(v.alias("b"), "class_id").where("a.variant < b.variant").select("class_id", F.col("a.variant").alias("va"), F.col("b.variant").alias("vb"))
    left = kept.select("class_id", F.col("variant").alias("va"), F.col("doc_id").alias("x"))
    right = kept.select("class_id", F.col("variant").alias("vb"), F.col("doc_id").alias("y"))
    pairs = links.join(left, ["class_id", "va"]).join(right, ["class_id", "vb"]).where("x <> y")
    return pairs.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
