"""Problem 10: texts cut off by a field limit or a broken transfer.

Method: a corpus vocabulary trie, combined with evidence of length. One pass over
all documents counts the words inside texts (the last word of an unfinished text
is not counted), which of them end finished lines without a mark, how lines begin
and end, and how long texts are. The trie is a table of all prefixes of the known
words, with the number of documents below each node, so it grows with the
vocabulary in a distributed table and not in a task.

A text ends well when its last sentence has an end mark (closing quotes,
brackets, markup and white space aside); three points or a broken character are
none. An unfinished text is cut

* ``word``: when its last word is a proper prefix of known words and not known
  itself, or hardly (in under 1 % of the documents below it, and its length or its
  line speak against it too),
* ``limit``: when its last line is no list item or reference and its length lies at
  a limit of its source: a length just below which many more unfinished texts end
  than below and above that,
* ``phrase``: when its last word is known, and in the trie's counts hardly ever ends
  a finished line without a mark,
* ``sentence``: when its last line begins as sentences of this corpus do (most lines
  with that first word, or with that second word after a rare first one, have an
  end mark), unless the document writes its sentences without marks,
* ``ellipsis``, ``broken``: when it ends in three points or a broken character.

Endings that many documents share after different lines (closings, signatures)
are meant so, and so are list items, references, addresses and headings, unless
the last word speaks against it.

Null, empty and blank texts are not cut. A null source is a source of its own.
Repeated rows are judged alike. Texts are read whole. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioquery.session import written

BREAK = re.compile(r"\r\n|[\r\n\x0b\x0c\x85\u2028\u2029]|<br\s*/?>|</?(?:p|li|div|ul|ol|tr|td|h[1-6])(?:\s[^<>]*)?>", re.I)
MARKUP = re.compile(r"</?\w+[^<>]*>$")
BLANKS = "\u200b\ufeff"
CLOSERS = "\"'”’»)]"
END_MARKS = ".!?。！？．؟।:;–—"
SENTENCE = re.compile(r"(?<=[.!?。！？])[\"'”’»)\]]*\s+")
ITEM = re.compile(r"^(?:[-•*·▪◦☐☑☒]|\d{1,3}[.)]|[a-zA-Z][.)])\s+\S")
REFERENCE = re.compile(r"--\s|\S[^:]{0,30}:\s")
ADDRESS = re.compile(r"\w+://\S+$|\S+@\S+$")
WORD = re.compile(r"[^\W_]+")
LIMIT = 12  # a word's worth of characters below a limit
MANY = 3  # different lines before a shared ending
MOST = 200_000  # counts a task holds before it hands them on
DEEP = 64  # words up to this length have all their prefixes in the trie
ENDS = "doc_id long, source string, chars long, bytes long, mark string, tail string, prev long, w1 string, w2 string, last string, shape string, plain boolean"
COUNTS = "kind string, key string, a long, b long"
PARSED = f"{ENDS}, {COUNTS}"


def stripped(text: str) -> str:
    """text without white space and markup at its end."""
    while True:
        text = text.rstrip().rstrip(BLANKS)
        if text.endswith("&nbsp;"):
            text = text[:-6]
        elif text.endswith(">") and (m := MARKUP.search(text, max(0, text.rfind("<")))):
            text = text[: m.start()]
        elif not text[-1:].isspace():
            return text


def done(seg: str) -> bool:
    """Whether a line ends in an end mark, closing signs aside."""
    last = seg.rstrip(CLOSERS + "*_")[-1:]
    return last != "" and last in END_MARKS


def elided(seg: str) -> bool:
    return seg.rstrip(CLOSERS).endswith(("...", "…"))


def mark_of(seg: str) -> str:
    """How a last line ends: 'end' is well."""
    return "ellipsis" if elided(seg) else "broken" if seg.endswith("\ufffd") else "end" if done(seg) else "open"


def segments(text: str) -> list[str]:
    """The lines of a text, cut further after sentences."""
    out = []
    for line in BREAK.split(text):
        line = line.strip()
        if line:
            out += [x for x in SENTENCE.split(line) if x]
    return out


def _shape(seg: str) -> str:
    if ITEM.match(seg):
        return "item"
    if REFERENCE.match(seg):
        return "reference"
    last = seg.rsplit(None, 1)[-1]
    return "reference" if ("://" in last or "@" in last) and ADDRESS.search(last) else "line"


def _ending(segs: list[str]) -> tuple:
    """mark, digest of the tail, hash of the line before, first, second and last word, shape,
    and whether the text writes sentences without end marks."""
    tail = segs[-1]
    mark = mark_of(tail)
    bare = tail.lower().rstrip()
    if mark != "open":  # the last word is what stands before the sign
        bare = bare.rstrip(CLOSERS).rstrip(".…\ufffd")
    words = WORD.findall(bare)
    long = [s for s in segs[:-1] if len(s.split()) >= 5 and _shape(s) == "line"]
    open_ = sum(1 for s in long if not done(s))
    prev = xxhash.xxh64_intdigest(segs[-2].lower() if len(segs) > 1 else "") >> 1
    ends_in_word = mark != "end" and bool(words) and bare.endswith(words[-1])
    digest = xxhash.xxh3_128_hexdigest(re.sub(r"\d+", "0", tail.lower()).encode("utf-8", "replace"))
    return mark, digest, prev, words[0] if words else None, words[1] if len(words) > 1 else None, words[-1] if ends_in_word else None, _shape(tail), len(long) >= 2 and open_ > len(long) / 2


def _count(segs: list[str], held: dict[tuple[str, str], list[int]]) -> None:
    seen: set[str] = set()
    for i, s in enumerate(segs):
        words = WORD.findall(s.lower())
        final = i == len(segs) - 1 and mark_of(s) != "end"
        bare = not done(s)
        seen.update(words[:-1] if final else words)
        if final or not words:
            continue
        if _shape(s) == "line":
            held["first", words[0]][bare] += 1
            if len(words) > 1:
                held["second", words[1]][bare] += 1
        if bare:
            held["last", words[-1]][0] += 1
    for w in seen:
        held["word", w][0] += 1


def parsed(documents: DataFrame) -> DataFrame:
    """PARSED: the ENDS of every document whose text has any ink, and COUNTS of
    the words, in one pass. Counts are summed within tasks as far as they go.
    kind word: a = documents with the word inside; first, second: a = lines with
    that word there and an end mark, b = without; last: a = lines without a mark
    that end in it. Rows of the one sort have nulls in the columns of the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        big, text = pa.int64(), pa.string()
        ends = [big, text, big, big, text, text, big, text, text, text, text, pa.bool_()]
        counts = [text, text, big, big]
        names = [c.split()[0] for c in PARSED.split(", ")]
        held: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0])

        def batch(rows: list[tuple], of: list, before: list, after: list) -> pa.RecordBatch:
            none = lambda types: [pa.nulls(len(rows), t) for t in types]
            return pa.RecordBatch.from_arrays([*none(before), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(of)), *none(after)], names=names)

        def flush() -> pa.RecordBatch:
            rows = [(*k, *v) for k, v in held.items()]
            held.clear()
            return batch(rows, counts, ends, [])

        for b in batches:
            rows = []
            for doc, source, content in zip(*(c.to_pylist() for c in b.columns)):
                segs = segments(stripped(content))
                if segs:
                    rows.append((doc, source, len(content), len(content.encode("utf-8", "replace")), *_ending(segs)))
                    _count(segs, held)
            yield batch(rows, ends, [], counts)
            if len(held) > MOST:
                yield flush()
        yield flush()

    return documents.filter("text is not null").select("doc_id", "source", "text").mapInArrow(run, PARSED)


def trie(words: DataFrame, least: int = 2) -> DataFrame:
    """(node, below): every proper prefix, of up to DEEP characters, of a word in
    at least ``least`` documents, and how many documents have words below it."""
    known = words.filter(F.col("a") >= least).filter(F.length("key") > 1)
    deep = F.least(F.length("key") - 1, F.lit(DEEP))
    node = F.explode(F.transform(F.sequence(F.lit(1), deep), lambda n: F.substring("key", F.lit(1), n)))
    return known.select(node.alias("node"), "a").groupBy("node").agg(F.sum("a").alias("below"))


def deeper(words: DataFrame, asked: DataFrame, least: int = 2) -> DataFrame:
    """(node, below) of the asked nodes over DEEP characters: they meet the words
    that begin with the same DEEP ones."""
    top = lambda c: F.substring(c, 1, DEEP)
    long = words.filter((F.col("a") >= least) & (F.length("key") > DEEP + 1)).select("key", "a", top("key").alias("top"))
    nodes = asked.filter(F.length("node") > DEEP).select("node").distinct().withColumn("top", top("node"))
    below = nodes.join(long, "top").filter(F.col("key").startswith(F.col("node")) & (F.col("key") != F.col("node")))
    return below.groupBy("node").agg(F.sum("a").alias("below"))


def limits(ends: DataFrame, least: int = 8, sure: float = 6.0) -> DataFrame:
    """(source, unit, size): lengths just below which a source's unfinished texts
    pile up: at least ``least`` within a word's worth, and more by ``sure``
    deviations than in the same space above or, on average, below. Texts that end
    alike count once, so copies make no limit."""
    unit = lambda u: F.struct(F.lit(u).alias("unit"), F.col(u).alias("size"))
    sizes = ends.filter("mark <> 'end' and shape = 'line'").select("source", "tail", F.explode(F.array(unit("chars"), unit("bytes"))).alias("x")).select("source", "tail", "x.*").distinct()
    n = sizes.groupBy("source", "unit", "size").agg(F.count("*").alias("n"))
    # one row per length that a source has: few, however many its texts
    by = Window.partitionBy("source", "unit").orderBy("size")
    over = lambda a, b: F.coalesce(F.sum("n").over(by.rangeBetween(a, b)), F.lit(0))
    n = n.withColumns({"at": over(-LIMIT, 0), "above": over(1, LIMIT + 1), "under": over(-4 * LIMIT - 4, -LIMIT - 1) / 3})
    base = F.greatest("above", "under")
    ok = (F.col("at") >= least) & (F.col("at") - base >= sure * F.sqrt(base + 1)) & (F.col("size") > 3 * LIMIT)
    # the last of neighbouring sizes
    n = n.filter(ok).withColumn("next", F.lead("size").over(by))
    return n.filter(F.col("next").isNull() | (F.col("next") > F.col("size") + LIMIT)).select("source", "unit", "size")


def judged(documents: DataFrame) -> DataFrame:
    """(doc_id, source, cut, why) of every document."""
    both = written(parsed(documents), "p10-parsed")
    ends = both.filter("doc_id is not null").select(*[c.split()[0] for c in ENDS.split(", ")])
    counts = written(both.filter("kind is not null").groupBy("kind", "key").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "p10-counts")
    unfinished = ends.filter("mark <> 'end'")

    shared = unfinished.filter("mark = 'open'").select("tail", "prev").distinct().groupBy("tail").agg(F.count("*").alias("lines"))
    lim = limits(ends)
    unit = lambda u: F.struct(F.lit(u).alias("unit"), F.col(u).alias("len"))
    at = unfinished.select("doc_id", "source", F.explode(F.array(unit("chars"), unit("bytes"))).alias("x")).select("doc_id", "source", "x.*").alias("x")
    # few limits per source; the band join runs within a source and unit
    near = at.join(lim.alias("l"), F.col("x.source").eqNullSafe(F.col("l.source")) & (F.col("x.unit") == F.col("l.unit")) & F.col("len").between(F.col("size") - LIMIT, F.col("size"))).select("doc_id").distinct().withColumn("limit", F.lit(True))

    # every count that an end asks for, in one join
    asks = unfinished.select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("key")) for k, c in (("first", "w1"), ("second", "w2"), ("last", "last"), ("word", "last"), ("node", "last"))])).alias("x")).select("doc_id", "x.*").filter("key is not null").distinct()
    words = counts.filter("kind = 'word'")
    nodes = trie(words).unionByName(deeper(words, asks.filter("kind = 'node'").select(F.col("key").alias("node"))))
    known = counts.unionByName(nodes.select(F.lit("node").alias("kind"), F.col("node").alias("key"), F.col("below").alias("a"), F.lit(0).cast("long").alias("b")))
    of = lambda kind, c, name: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col(c))), F.lit(0)).alias(name)
    facts = asks.join(known, ["kind", "key"]).groupBy("doc_id").agg(of("first", "a", "first_done"), of("first", "b", "first_open"), of("second", "a", "second_done"), of("second", "b", "second_open"), of("last", "a", "finals"), of("word", "a", "docs"), of("node", "a", "below"))

    d = unfinished.join(shared, "tail", "left").join(near, "doc_id", "left").join(facts, "doc_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))

    def rate(done: str, bare: str) -> Column:
        n = zero(done) + zero(bare)
        return F.when(n >= 5, zero(done) / n)

    sentence = F.coalesce(rate("first_done", "first_open"), rate("second_done", "second_open"), F.lit(0.0)) >= 0.6
    line = F.col("shape") == "line"
    limit = F.coalesce("limit", F.lit(False))
    ends_in = F.col("last").isNotNull() & (zero("below") > 0)
    unknown = ends_in & (zero("docs") == 0)
    hardly = ends_in & (zero("docs") * 100 < zero("below"))
    stump = unknown | (hardly & (limit | (line & sentence)))
    dangling = F.col("last").isNotNull() & (zero("docs") >= 5) & (zero("finals") * 500 <= zero("docs"))
    closing = (F.col("mark") == "open") & (zero("lines") >= MANY) & ~(line & sentence)
    why = (
        F.when(closing & ~stump, None)
        .when(stump, "word")
        .when(line & limit, "limit")
        .when(dangling & (F.col("shape") != "reference"), "phrase")
        .when(line & sentence & ~F.col("plain"), "sentence")
        .when(F.col("mark") != "open", F.col("mark"))
    )
    # repeated rows are judged alike; of rows that differ the strongest reason counts
    found = d.select("doc_id", why.alias("why")).filter("why is not null").groupBy("doc_id").agg(F.max("why").alias("why"))
    return documents.select("doc_id", "source").join(found, "doc_id", "left").select("doc_id", "source", F.col("why").isNotNull().alias("cut"), "why")


def found(documents: DataFrame) -> DataFrame:
    """(doc_id) of the documents that were cut."""
    return judged(documents).filter("cut").select("doc_id").distinct()


def reasons(documents: DataFrame) -> DataFrame:
    """(doc_id, why) of the documents that were cut."""
    return judged(documents).filter("cut").select("doc_id", "why").distinct()


def rates(documents: DataFrame) -> DataFrame:
    """(source, documents, cut, rate): how often each source truncates."""
    g = judged(documents).groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("cut").cast("long")).alias("cut"))
    return g.select("source", "documents", "cut", (F.col("cut") / F.col("documents")).alias("rate"))
