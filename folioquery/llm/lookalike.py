"""Problem 4: one form for texts that look alike but differ in characters.

Method: edges between strings and code points that cannot be told apart by eye
are closed by union-find into transitive classes. The form of a class is its
member most frequent in the corpus (of a class with strings of several code
points, the most frequent of the longest ones, so that joined letters are always
taken apart). A multi-pattern automaton then rewrites each text greedily, the
longest pattern first from the left, between canonical decomposition and
composition.

Alike are: signs without ink (dropped), blanks of any width (one blank each; a
run of blanks stays a run), glyphs of other width, ways to encode an accent or a
joined letter, line ends, and letters of another alphabet drawn alike. Case,
accents, digits against letters, dashes and quotation marks stay as they are.

Null texts give null, empty texts ''. Empty tables give empty results. Texts are
taken whole whatever their length.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.session import written

# Letters of other alphabets that are drawn like the Latin letter
# named before them.
DRAWN_ALIKE = {
    "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һհ", "i": "і", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "оοօ", "p": "р", "q": "ԛ", "s": "ѕ", "u": "ս",
    "v": "ѵν", "w": "ԝ", "x": "х", "y": "у", "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "M": "МΜ", "N": "Ν",
    "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "U": "Ս", "W": "Ԝ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ", "Γ": "Г", "Π": "П", "Φ": "Ф", "Đ": "Ð", "ə": "ә", "æ": "ӕ", "Æ": "Ӕ",
}
CHEROKEE = {"A": "Ꭺ", "B": "Ᏼ", "C": "Ꮯ", "D": "Ꭰ", "E": "Ꭼ", "G": "Ꮐ", "H": "Ꮋ", "J": "Ꭻ", "K": "Ꮶ", "L": "Ꮮ", "M": "Ꮇ", "P": "Ꮲ", "R": "Ꭱ", "S": "Ꮪ", "T": "Ꭲ", "V": "Ꮩ", "W": "Ꮃ", "Z": "Ꮓ"}
LISU = {"A": "ꓮ", "B": "ꓐ", "C": "ꓚ", "D": "ꓓ", "E": "ꓰ", "F": "ꓝ", "G": "ꓖ", "H": "ꓧ", "I": "ꓲ", "J": "ꓙ", "K": "ꓗ", "L": "ꓡ", "M": "ꓟ", "N": "ꓠ", "O": "ꓳ", "P": "ꓑ", "R": "ꓣ", "S": "ꓢ", "T": "ꓔ", "U": "ꓴ", "V": "ꓦ", "W": "ꓪ", "X": "ꓫ", "Y": "ꓬ", "Z": "ꓜ"}
LINE_ENDS = "\x0b\x0c\x85\u2028\u2029"
FILLERS = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0}
CONTROL = re.compile(r"[\x00-\x09\x0b-\x1f\x7f]")
LAST = 0x1FFFF  # no decomposition of interest beyond, but for compatibility ideographs
JOINED = {"<compat>", "<isolated>", "<initial>", "<medial>", "<final>"}


def _invisible(c: int, ch: str) -> bool:
    if c in FILLERS or 0xFE00 <= c <= 0xFE0F or 0x180B <= c <= 0x180F:
        return True
    kind = unicodedata.category(ch)
    return kind == "Cc" and ch not in "\t\n\r" + LINE_ENDS or kind == "Cf" and "NUMBER" not in unicodedata.name(ch, "") and "END OF" not in unicodedata.name(ch, "")


@cache
def _rules() -> tuple[dict[int, str], list[tuple[str, str]]]:
    """What is dropped or becomes a blank, and the edges between strings."""
    first: dict[int, str] = {}
    edges: list[tuple[str, str]] = []
    for c in range(LAST + 1):
        ch = chr(c)
        if 0xD800 <= c <= 0xDFFF:
            continue
        if _invisible(c, ch):
            first[c] = ""
        elif unicodedata.category(ch) == "Zs" or ch in "\t\u2800":
            first[c] = " "
        elif ch in LINE_ENDS:
            first[c] = "\n"
        tag, _, _ = unicodedata.decomposition(ch).partition(" ")
        if tag in ("<wide>", "<narrow>"):
            edges.append((ch, unicodedata.normalize("NFKD", ch)))
        elif tag in JOINED:
            full = unicodedata.normalize("NFKD", ch)
            letters = all(unicodedata.category(x)[0] in "LM" for x in full)
            if letters and "ſ" not in unicodedata.normalize("NFD", ch) and (len(full) > 1 and "LONG S" not in unicodedata.name(ch, "") or tag != "<compat>" or "RADICAL" in unicodedata.name(ch, "") or ch == "µ"):
                edges.append((ch, full))
    first |= dict.fromkeys([*range(0xE0000, 0xE0080), *range(0xE0100, 0xE01F0)], "")
    edges += [(latin, x) for table in (DRAWN_ALIKE, CHEROKEE, LISU) for latin, others in table.items() for x in others]
    return first, edges


@cache
def _first_signs() -> dict[str, str]:
    return {chr(c): s for c, s in _rules()[0].items() if chr(c) != s}


@cache
def _classes() -> tuple[list[list[str]], Counter]:
    """The strings that look the same, by union-find over the edges, and how many
    edges name each as the plain form."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    prior: Counter = Counter()
    for a, b in _rules()[1]:
        prior[a if len(b) == 1 and ord(a) < ord(b) else b] += 1
        root[find(a)] = find(b)
    classes: dict[str, list[str]] = {}
    for x in list(root):
        classes.setdefault(find(x), []).append(x)
    return list(classes.values()), prior


def _contested() -> list[str]:
    """The members whose frequency can decide: the longest of their class, where
    these are several."""
    out = []
    for members in _classes()[0]:
        size = max(map(len, members))
        longest = [x for x in members if len(x) == size]
        out += longest if len(longest) > 1 else []
    return sorted(out)


class Forms:
    """The classes and the automaton that rewrites texts to them."""

    def __init__(self, frequency: dict[str, int] | None = None):
        frequency = frequency or {}
        classes, prior = _classes()
        self.form: dict[str, str] = {}
        for members in classes:
            size = max(map(len, members))
            best = max((x for x in members if len(x) == size), key=lambda x: (frequency.get(x, 0), prior[x], -ord(x[0])))
            self.form |= {x: best for x in members if x != best}
        # A form may itself hold letters of another class.
        single = {k: v for k, v in self.form.items() if len(k) == 1}
        self.form = {k: "".join(single.get(c, c) if len(v) > 1 else c for c in v) for k, v in self.form.items()}
        self.plain = not any(k.isascii() for k in self.form)
        self.automaton = ahocorasick.Automaton()
        for k, v in self.form.items():
            self.automaton.add_word(k, (len(k), v))
        self.automaton.make_automaton()
        self.heads = {k[0] for k in self.form}

    def __reduce__(self):
        return _restore, (self.form,)

    def rewrite(self, text: str) -> str:
        if self.plain and text.isascii() and not CONTROL.search(text):
            return text
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        first = _first_signs()
        for c in set(text) & first.keys():
            text = text.replace(c, first[c])
        text = unicodedata.normalize("NFD", text)
        if not self.heads.isdisjoint(set(text)):  # most texts have no pattern to look for
            text = self._replaced(text)
        return unicodedata.normalize("NFC", text)

    def _replaced(self, text: str) -> str:
        out, at = [], 0
        for end, (size, form) in self.automaton.iter_long(text):
            out += (text[at : end - size + 1], form)
            at = end + 1
        return "".join([*out, text[at:]])


_KEPT: dict[int, Forms] = {}


def _restore(form: dict[str, str]) -> Forms:
    """A worker builds the automaton once and keeps it."""
    key = hash(tuple(form.items()))
    if key not in _KEPT:
        made = Forms.__new__(Forms)
        made.form, made.plain = form, not any(k.isascii() for k in form)
        made.automaton = ahocorasick.Automaton()
        for k, v in form.items():
            made.automaton.add_word(k, (len(k), v))
        made.automaton.make_automaton()
        made.heads = {k[0] for k in form}
        _KEPT[key] = made
    return _KEPT[key]


@cache
def default_forms() -> Forms:
    """Forms that do not depend on a corpus, so that batches agree."""
    return Forms()


def corpus_forms(*texts: DataFrame) -> Forms:
    """Forms with the representatives most frequent in all of the one-column
    frames given. To the driver comes one count per member of a class."""
    members = _contested()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        several = [x for x in members if len(x) > 1]
        for b in batches:
            joined = "\x00".join(x for x in b.column(0).to_pylist() if x)
            seen.update(joined)
            for x in several:
                if (n := joined.count(x)) > 0:
                    seen[x] += n
        keep = [(x, seen[x]) for x in members if seen[x]]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keep], pa.string()), pa.array([n for _, n in keep], pa.int64())], names=["s", "n"])

    counts: Counter = Counter()
    for t in texts:
        for r in t.mapInArrow(count, "s string, n long").groupBy("s").agg(F.sum("n").alias("n")).collect():
            counts[r["s"]] += r["n"]
    return Forms(counts)


def canonical(df: DataFrame, column: str, out: str, forms: Forms) -> DataFrame:
    """df with the string column ``out``: the one form of ``column``. A column of
    that name is replaced. Texts of ASCII alone never leave the JVM."""
    if out != column:
        df = df.drop(out)
    else:
        return canonical(df.withColumnRenamed(column, "__text"), "__text", out, forms).drop("__text")
    odd = F.col(column).rlike(r"[^\x20-\x7e\n]") if forms.plain else F.lit(True)
    schema = df.withColumn(out, F.lit("").cast("string")).schema
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [None if x is None else forms.rewrite(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(done, pa.string())], names=[*b.schema.names, out])

    same = df.filter(~F.coalesce(odd, F.lit(False))).withColumn(out, F.col(column))
    return same.unionByName(df.filter(odd).mapInArrow(run, schema))


def alike_pairs(rows: DataFrame, forms: Forms) -> DataFrame:
    """(key_a, key_b): rows (key, text) of different non-empty texts with one
    form, key_a < key_b. Rows with a null key or text give none; repeated rows
    count once.

    Pairs are made of the texts of a class first and of rows only after that: a
    text with many copies and no lookalike makes no pair and meets no other row.
    """
    digest = lambda c: F.unhex(F.md5(c))
    kept = rows.filter(F.col("key").isNotNull() & (F.col("text") != ""))
    seen = canonical(kept.select("key", "text"), "text", "form", forms).select("key", digest("form").alias("form"), digest("text").alias("raw"))
    classes = seen.groupBy("form").agg(F.min("raw").alias("low"), F.max("raw").alias("high")).filter("low <> high").select("form")
    few = written(seen.join(classes, "form").distinct(), "p4-few")
    variants = few.select("form", "raw").distinct()
    pairs = variants.withColumnRenamed("raw", "raw_a").join(variants.withColumnRenamed("raw", "raw_b"), "form").filter("raw_a < raw_b")
    a = few.select("form", F.col("raw").alias("raw_a"), F.col("key").alias("ka"))
    b = few.select("form", F.col("raw").alias("raw_b"), F.col("key").alias("kb"))
    found = pairs.join(a, ["form", "raw_a"]).join(b, ["form", "raw_b"])
    return found.filter("ka <> kb").select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")).distinct()


def found(blocks: DataFrame, terms: DataFrame) -> DataFrame:
    """(field, key_a, key_b) over the contents of blocks and the terms."""
    contents = blocks.select(F.concat("document_id", F.lit("/"), "block_id").alias("key"), F.col("content").alias("text"))
    words = terms.select("term").filter("term <> ''").distinct()
    words = words.select(F.col("term").alias("key"), F.col("term").alias("text"))
    forms = corpus_forms(contents.select("text"), words.select("text"))
    of = lambda f, rows: alike_pairs(rows, forms).select(F.lit(f).alias("field"), "key_a", "key_b")
    return of("content", contents).unionByName(of("term", words))
