"""Text functions as Column expressions: tokens, stems, classes, snippets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stop words.
STOP_WORDS = (
    "the a an this that these those and or but nor yet so for because although though while whereas unless if then "
    "in on at to of with by from as into through during before after above below between under over out up down off about against "
    "among around within without upon along across behind beyond toward towards beside besides beneath onto "
    "is was are were been be being am have has had having do does did doing done "
    "will would could should may might must shall can it its itself they their theirs them themselves we our ours us ourselves "
    "you your yours yourself yourselves he she him her his hers himself herself i me my mine myself who whom whose which what "
    "not no none never neither all each every both few more most other some any many much several enough less least little "
    "such than too very just also now only here there where when why how again further once already always ever still even well back "
    "else however therefore thus hence otherwise rather quite perhaps maybe own same either another anything everything nothing something someone "
    "anyone everyone nobody somebody anybody one two first last next new old high long"
).split()
# Endings that a stem replaces, and endings that it drops, in order.
REPLACED = "ization:ize ational:ate fulness:ful ousness:ous iveness:ive tional:tion ation:ate enci:ence anci:ance izer:ize ator:ate ies:i ied:i"
DROPPED = "iveness fulness ousness ational alism aliti iviti biliti tional ation ator izer ness ment logi able ible ism ate iti ous ive ize ing ion ity ful ant ent al er ic ly ed es s"
# Signs that begin a list item.
BULLETS = "•●○■□▪▫-*‣◦"
NUMBERED = r"^(\d+[.)]\s|[(]\d+[)]\s|[a-z][.)]\s)"
HEADING_NUMBER = r"^[\d.]+\s+[A-Z]"
HEADING_WORD = r"^(Chapter|Section|Part|CHAPTER|SECTION|PART)\s+\d+"
PUNCTUATION = ".,!?;:\"'()[]{}"
TOKEN = r"[\p{L}\p{Nd}]+"

# How queries of each kind begin or what they hold, in the order
# in which the kinds are tried.
ASKING = r"\s+(is|are|was|were|does|do|did|can|could|would|should|will|has|have|had"
QUERY_KINDS = {
    "comparison": [
        r"^compare\b", r"^comparison\s+(of|between)\b", r"^what\s+(is|are)\s+the\s+difference", r"^differences?\s+between\b",
        r"^how\s+(is|are|does|do)\s+.+\s+(differ|different|compare)", r"\bvs\.?\b", r"\bversus\b", r"\bcontrast\b", r"\bcompared\s+to\b",
        r"\bin\s+comparison\s+to\b", r"\bas\s+opposed\s+to\b", r"\bwhile\b.+\bdifference\b",
    ],
    "summary": [
        r"^give\s+(me\s+)?an?\s+(summary|overview)\b", r"^brief\s+me\b", r"^in\s+(short|brief)\b", r"^(key|main)\s+points\b", r"^highlights?\s+of\b",
        r"^what\s+are\s+the\s+(main|key)\s+points\b", r"^condense\b", r"summarize|summary|overview|tldr|tl;dr|recap",
    ],
    "list": [
        r"^list\b", r"^enumerate\b", r"^what\s+are\s+(all|the)\b", r"^give\s+(me\s+)?a\s+list\b", r"^provide\s+(a\s+)?list\b", r"^name\s+(all|the)\b",
        r"^show\s+(me\s+)?all\b", r"^all\s+the\b", r"^every\b", r"^how\s+many\b", r"^count\s+(all\s+)?the\b", r"^what\s+(types|kinds)\b", r"^which\s+.+\s+are\s+there\b",
    ],
    "definition": [
        r"^define\b", r"^definition\s+of\b", r"^what\s+is\s+the\s+definition\b", r"^what\s+does\s+.+\s+mean\b", r"^meaning\s+of\b", r"^what\s+is\s+meant\s+by\b",
        r"^explain\s+what\b", r"^explain\s+the\s+term\b", r"^what\s+is\s+an?\b", r"^what\s+are\b",
    ],
    "navigation": [r"^(show me|show the|find the|find me|go to|navigate to|take me to|where is the|where can i find|look up|search for|locate|get the|open the|display the)"],
    "factual": [rf"^(what|who|when|where|why){ASKING})\b", rf"^how{ASKING}|much|many|long|often)\b", r"^(is|are)\s+there\b", r"^(does|do|can|could|would|should)\b", r"\?$"],
}
SUGGESTED = {"factual": "hybrid", "definition": "hybrid", "navigation": "keyword", "list": "keyword", "summary": "semantic", "comparison": "semantic", "unknown": "hybrid"}
DESCRIBED = {
    "factual": "asks for a fact", "navigation": "wants to get to a place in the documents", "summary": "wants a short account of something",
    "comparison": "sets two or more things against each other", "definition": "asks what a term means", "list": "wants all items of a kind", "unknown": "shows no clear intent",
}


def tokens(text: Column, stop_words: bool = True) -> Column:
    """Runs of letters and digits, lower-cased, of at least two bytes, without
    stop words unless ``stop_words`` is false. Null gives an empty array."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    long = F.filter(found, lambda w: F.octet_length(w) >= 2)
    return F.filter(long, lambda w: ~w.isin(STOP_WORDS)) if stop_words else long


def stem(word: Column) -> Column:
    """The first ending that leaves two bytes is replaced or else dropped; words
    of up to three bytes stay. One expression of builtin functions."""
    rules = [tuple(r.split(":")) for r in REPLACED.split()] + [(s, "") for s in DROPPED.split()]
    out = F.when(F.octet_length(word) <= 3, word)
    for ending, instead in rules:
        n = len(ending)
        cut = F.substring(word, F.lit(1), F.char_length(word) - n)
        out = out.when(word.endswith(ending) & (F.octet_length(word) >= n + 2), F.concat(cut, F.lit(instead)) if instead else cut)
    return out.otherwise(word)


def stemmed_vocabulary(words: DataFrame, column: str) -> DataFrame:
    """(word, stem) of each distinct word: stems are made once per word and
    joined back, not once per occurrence."""
    return words.select(F.col(column).alias("word")).filter("word is not null").distinct().select("word", stem(F.col("word")).alias("stem"))


def normalized(text: Column) -> Column:
    """Lower case, single blanks, without punctuation, trimmed."""
    return F.trim(F.translate(F.regexp_replace(F.lower(text), r"\s+", " "), PUNCTUATION, ""))


def _any(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


def query_kind(text: Column) -> Column:
    """Intent of a query; null is 'unknown'."""
    q = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    out = None
    for kind, patterns in QUERY_KINDS.items():
        hit = _any(q, patterns)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("unknown")


def _chosen(kind: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), kind)


def suggested_mode(kind: Column) -> Column:
    return F.coalesce(_chosen(kind, SUGGESTED), F.lit("hybrid"))


def described(kind: Column) -> Column:
    return F.coalesce(_chosen(kind, DESCRIBED), F.lit("no known kind of query"))


def is_bold(font: Column) -> Column:
    name = F.lower(F.coalesce(font, F.lit("")))
    return name.contains("bold") | name.contains("black") | name.contains("heavy")


def is_italic(font: Column) -> Column:
    name = F.lower(F.coalesce(font, F.lit("")))
    return name.contains("italic") | name.contains("oblique")


def is_heading(text: Column, size: Column, bold: Column) -> Column:
    """By size, weight, numbering, capitals or a heading word; blank is none."""
    t = F.trim(F.coalesce(text, F.lit("")))
    n = F.octet_length(t)
    capitals = (n < 100) & (n > 3) & t.rlike(r"\p{L}") & (F.upper(t) == t)
    hit = (F.coalesce(size, F.lit(0.0)) >= 14) | (F.coalesce(bold, F.lit(False)) & (n < 200)) | (t.rlike(HEADING_NUMBER) & (n < 150)) | capitals | t.rlike(HEADING_WORD)
    return (n > 0) & hit


def is_page_heading(text: Column, size: Column, font: Column) -> Column:
    """The rule for page layouts, where paragraphs have no numbering."""
    t = F.trim(F.coalesce(text, F.lit("")))
    n = F.octet_length(t)
    return (n > 0) & ((F.coalesce(size, F.lit(0.0)) > 14) | F.lower(F.coalesce(font, F.lit(""))).contains("bold") | ((n > 3) & (n < 100) & (F.upper(t) == t)))


def heading_level(size: Column, bold: Column) -> Column:
    s = F.coalesce(size, F.lit(0.0))
    return F.when(s >= 24, 1).when(s >= 20, 2).when(s >= 16, 3).when(s >= 14, 4).when((s >= 12) & F.coalesce(bold, F.lit(False)), 5).otherwise(6)


def is_list_item(text: Column) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    return (t != "") & (F.substring(t, 1, 1).isin(list(BULLETS)) | t.rlike(NUMBERED))


def quoted(text: Column) -> Column:
    """text as a literal inside a regular expression."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def snippet(text: Column, query: Column, pre: str = "", post: str = "") -> Column:
    """The first place of the whole query with 50 characters before and 100
    after it, or the beginning; every place is marked. Null text gives null."""
    found = F.position(F.lower(query), F.lower(text))
    begin = F.greatest(found - 50, F.lit(1))
    end = F.least(found + F.char_length(query) + 100, F.char_length(text) + 1)
    inside = F.concat(F.when(begin > 1, "...").otherwise(""), F.substring(text, begin, end - begin), F.when(end <= F.char_length(text), "...").otherwise(""))
    if pre and post:
        inside = F.regexp_replace(inside, F.concat(F.lit("(?iu)"), quoted(query)), F.lit(f"{pre}$0{post}"))
    start = F.when(F.char_length(text) > 200, F.concat(F.substring(text, 1, 200), F.lit("..."))).otherwise(text)
    return F.when((found > 0) & (query != ""), inside).otherwise(start)


def highlighted(text: Column, terms: list[str], pre: str, post: str) -> Column:
    """The first 200 characters with every term marked, where terms overlap the
    longer one."""
    s = F.when(F.char_length(text) > 200, F.concat(F.substring(text, 1, 200), F.lit("..."))).otherwise(text)
    if not terms or not pre or not post:
        return s
    pattern = "(?iu)" + "|".join("\\Q" + t.replace("\\E", "") + "\\E" for t in sorted(terms, key=lambda t: (-len(t), t)))
    return F.regexp_replace(s, pattern, f"{pre}$0{post}")


def excerpt(text: Column, position: Column, window: int) -> Column:
    """Words around a word position."""
    words = F.split(F.trim(text), r"\s+")
    begin = F.greatest(position - window, F.lit(0))
    part = F.slice(words, begin + 1, F.lit(2 * window + 1))
    return F.concat(F.when(begin > 0, "...").otherwise(""), F.array_join(part, " "), F.when(begin + 2 * window + 1 < F.size(words), "...").otherwise(""))


def or_default(value: Column, default: str) -> Column:
    return F.coalesce(F.when(value != "", value), F.lit(default))


def image_format(name: Column) -> Column:
    f = F.regexp_replace(F.lower(F.trim(name)), r"^\.", "")
    f = F.when(f == "jpg", "jpeg").when(f == "tif", "tiff").otherwise(f)
    return F.when(f.isin("jpeg", "png", "gif", "bmp", "tiff", "webp", "jp2", "svg", "emf", "wmf"), f)


def file_format(path: Column) -> Column:
    """'pdf', 'docx', or null for what no parser takes."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.when(ext.isin("pdf", "docx"), ext)
