"""Repair text from scanned pages.

Words are counted over all pages. The anagram hash of a word is the sum of the fifth powers
of its characters, so a confusion such as ``rn`` for ``m`` shifts it by the same amount
wherever it stands: rare words are joined with frequent ones on shifted hashes, and the
best-ranked reading corrects them. Broken words are told from compounds by how often either
form occurs, and lines at page edges that recur in a packet, or count its pages, are furniture.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafline.functions.text import strip
from sheafline.plans.storage import small_or_shuffled, stored
from sheafline.sources.tables import table

#: What a scanner reads for what is printed.
CONFUSIONS = (
    ("c", "e"), ("b", "h"), ("y", "v"), ("i", "l"), ("1", "l"), ("1", "i"), ("0", "o"), ("5", "s"), ("6", "b"), ("9", "g"),
    ("@", "a"), ("!", "i"), ("+", "t"), ("ii", "u"), ("ri", "n"), ("rn", "m"), ("vv", "w"), ("cl", "d"), ("d", "ti"), ("m", "rn"),
)
#: A frequent word occurs so often; a rare reading of it so many times less.
FREQUENT, RATIO = 8, 5
#: A reading with a sign or digit inside needs only so many occurrences of the word.
FREQUENT_FOR_SIGNS = 3
#: Anagram hashes are sums modulo this prime.
PRIME = (1 << 31) - 1
#: The most frequent words, held in memory to pass over them quickly; all others are looked up by a join.
COMMON_WORDS = 200_000
#: Lines at each page edge that may be furniture, and pages of the packet a running line must be on.
EDGE, RUNNING = 2, 3

_TOKEN = re.compile(r"[^\s\-‐\xad¬—.,;:?()\"'|/\[\]]+")
_COMPOUND = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)+")
_BROKEN = re.compile(r"([^\s.,;:?()\"'|/\[\]]*[^\W_])[-‐\xad¬]\s*$")
#: What a line with a broken word ends with.
_HYPHENS = frozenset("-‐\xad¬")
_FIRST = re.compile(r"\s*([^\W\d_][^\s.,;:?()\"'|/\[\]]*)")
_CODE = re.compile(r"^[a-z]{2,4}\d{2}|\d{3}")
_LETTER = re.compile(r"[^\W\d_]")


def page_lines(text: str | None) -> list[str]:
    return text.split("\n") if text else []


def _parts(text: str | None):
    """For each line: its number, tokens, and the broken word at its end with the starts of the next lines."""
    lines = page_lines(text)
    carried = False
    for i, line in enumerate(lines):
        low = line.lower()
        tokens = _TOKEN.findall(low)
        tail = _BROKEN.search(low) if low.rstrip()[-1:] in _HYPHENS else None
        following = []
        if tail:
            j = i + 1
            while j < len(lines) and len(following) < 3:
                if lines[j].strip():
                    first = _FIRST.match(lines[j].lower())
                    following.append((j, re.sub(r"[-‐\xad¬]+$", "", first.group(1)) if first else ""))
                j += 1
            fragment = _TOKEN.findall(tail.group(1))
            tokens = tokens[: len(tokens) - 1] if fragment else tokens
        first = tokens[:1] if carried else []
        yield i, low, tokens[1:] if carried else tokens, first, tail.group(1) if tail else None, following
        if line.strip():
            carried = bool(tail)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words: list[str] = []
        for text in batch.column(0).to_pylist():
            for _, low, tokens, _, tail, _ in _parts(text):
                words += tokens
                if "-" in low:
                    words += [x for x in _COMPOUND.findall(low) if not (tail and tail.endswith(x))]
        seen = Counter(words)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])


def anagram_hash(word: Column) -> Column:
    """Sum of the fifth powers of the character codes, modulo PRIME at each step, so that no script and no length overflows."""

    def fifth(c: Column) -> Column:
        code = F.ascii(c).cast("long")
        square = code * code % PRIME
        return square * square % PRIME * code % PRIME

    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda t, c: (t + fifth(c)) % PRIME)


def _fifth(text: str) -> int:
    return sum(pow(ord(c), 5, PRIME) for c in text) % PRIME


def reads_as(seen: str, true: str, steps: list[tuple[str, str]]) -> bool:
    """Whether replacing one occurrence for each step turns ``seen`` into ``true``."""
    if not steps:
        return seen == true
    (a, b), rest = steps[0], steps[1:]
    at = seen.find(a)
    while at >= 0:
        if reads_as(seen[:at] + "\0" * len(b) + seen[at + len(a) :], "".join("\0" if at <= k < at + len(b) else c for k, c in enumerate(true)), rest) and true[at : at + len(b)] == b:
            return True
        at = seen.find(a, at + 1)
    return False


@F.pandas_udf(T.BooleanType())
def _reads(seen: pd.Series, true: pd.Series, steps: pd.Series) -> pd.Series:
    def check(s, t, k):
        pairs = [CONFUSIONS[i] for i in k if i >= 0]
        return any(reads_as(s, t, order) for order in (pairs, pairs[::-1]))

    return pd.Series([check(s, t, k) for s, t, k in zip(seen, true, steps)], dtype=bool)


def word_counts(texts: DataFrame) -> DataFrame:
    """Stored ``word, n`` over all texts; words cut at line ends are left out."""
    return stored(texts.where("text is not null").select("text").mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))


def corrections(counts: DataFrame) -> DataFrame:
    """Stored ``word, correct``: rare words and the frequent word they most likely are."""
    plain = F.col("word").rlike(r"^\p{L}+$")
    rare = counts.where(((F.length("word") >= 3) | ((F.length("word") == 2) & ~plain)) & F.col("word").rlike(r"\p{L}") & ~F.col("word").rlike(_CODE.pattern) & ~F.col("word").contains("-"))
    frequent = stored(counts.where(plain & (F.length("word") >= 2) & (F.col("n") >= FREQUENT_FOR_SIGNS)).select(F.col("word").alias("correct"), F.col("n").alias("m"), anagram_hash(F.col("word")).alias("hash")))
    shifts = F.array(*[F.when(F.contains("word", F.lit(a)), F.struct(F.lit(i).alias("i"), F.lit(_fifth(b) - _fifth(a)).cast("long").alias("shift"))) for i, (a, b) in enumerate(CONFUSIONS)])
    possible = rare.withColumn("s", F.array_compact(shifts)).where(F.size("s") > 0).withColumn("hash", anagram_hash(F.col("word")))
    none = F.array(F.struct(F.lit(-1).alias("i"), F.lit(0).cast("long").alias("shift")))
    steps = possible.select("word", "n", "hash", "s", F.explode("s").alias("a")).select("word", "n", "hash", "a", F.explode(F.concat(none, "s")).alias("b")).where("b.i < 0 or b.i >= a.i")
    tried = steps.select("word", "n", F.array("a.i", "b.i").alias("steps"), F.pmod(F.col("hash") + F.col("a.shift") + F.col("b.shift"), F.lit(PRIME)).alias("hash"), (F.col("b.i") >= 0).cast("int").alias("errors"))
    near = tried.join(small_or_shuffled(frequent), "hash").where("word <> correct")
    signs = ~plain
    likely = near.where((signs & (F.col("m") > F.col("n"))) | ((F.col("m") >= FREQUENT) & (F.col("m") >= RATIO * F.col("n"))))
    read = likely.where(_reads("word", "correct", "steps"))
    best = Window.partitionBy("word").orderBy("errors", F.desc("m"), "correct")
    return stored(read.withColumn("r", F.row_number().over(best)).where("r = 1").select("word", "correct"))


def _events(common):
    """Words to look up and words broken at line ends, of every line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fine = common.value
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                broken_at = None
                for i, _, tokens, first, tail, following in _parts(text):
                    for w in tokens:
                        if w not in fine and len(w) > 1 and _LETTER.search(w):
                            rows.append((key, i, "word", w, None, None))
                    if first and broken_at is not None and first[0] not in fine and len(first[0]) > 1:
                        rows.append((key, i, "rest", first[0], None, broken_at))
                    if tail is not None:
                        broken_at = i
                        for j, start in following or [(None, "")]:
                            rows.append((key, i, "break", tail, start, j))
            columns = list(zip(*rows)) if rows else [[]] * 6
            types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["page_key", "line_no", "kind", "a", "b", "other_line"])

    return run


def skeleton(line: Column) -> Column:
    """A line without the differences that misreading makes; standing numbers are equal."""
    s = F.regexp_replace(F.lower(strip(F.regexp_replace(line, r"(?U)\s+", " "))), r"(?<![\p{L}\p{Nd}])\p{Nd}+(?![\p{L}\p{Nd}])", "#")
    for a, b in (("ii", "u"), ("ri", "n"), ("rn", "m"), ("vv", "w"), ("cl", "d"), ("ti", "d")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.translate(s, "c@+!i10569hv", "eatlllosbgby")


#: Ways to print a page number.
PAGE_NUMBER = r"(?i)^[\[\(\-–—\s.]*(?:page|pg\.?|p\.?)?\s*([0-9lIOSB]{1,5}|[ivxlc]{1,8})\s*(?:(?:of|/)\s*[0-9lIOSB]{1,5})?[\]\)\-–—\s.]*$"
_BARE = r"^\s*[0-9]+\s*$"


@F.pandas_udf(T.IntegerType())
def _number(text: pd.Series) -> pd.Series:
    """Value of a page number in Arabic or Roman figures; misread figures count as such."""
    roman = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}

    def value(x):
        if x is None:
            return None
        low = x.lower()
        if re.fullmatch("[ivxlc]+", low) and not re.fullmatch("[li]*l+[li]*", x):
            v = [roman[c] for c in low]
            return sum(-n if k + 1 < len(v) and n < v[k + 1] else n for k, n in enumerate(v))
        return int(x.translate(str.maketrans("lIOSBosb", "11058058")) or 0) if re.fullmatch("[0-9lIOSBosb]+", x) else None

    return pd.Series([value(x) for x in text], dtype="Int32")


def furniture(pages: DataFrame) -> DataFrame:
    """``page_key, line_no, noise`` of running lines and page numbers of ``pages(page_key, packet_id, page_number, text)``."""
    blank = r"(?U)^\s*$"
    numbered = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("line_no"), x.alias("line"))), lambda x: ~x["line"].rlike(blank))
    edges = pages.where("text is not null").select("page_key", "packet_id", "page_number", numbered.alias("l")).select(
        "page_key", "packet_id", "page_number", F.size("l").alias("size"), F.posexplode(F.concat(F.slice("l", F.lit(1), F.lit(EDGE)), F.slice("l", F.greatest(F.lit(EDGE + 1), F.size("l") - EDGE + 1), F.lit(EDGE)))).alias("k", "x")
    )
    at = edges.select("page_key", "packet_id", "page_number", "k", "size", F.col("x.line_no").alias("line_no"), F.col("x.line").alias("line"))
    at = at.withColumn("figure", F.regexp_extract("line", PAGE_NUMBER, 1)).withColumn("like", skeleton(F.col("line"))).distinct()
    at = stored(at)
    running = at.where("figure = ''").groupBy("packet_id", "like").agg(F.count_distinct("page_key").alias("pages")).where(F.col("pages") >= RUNNING).select("packet_id", "like")
    running = small_or_shuffled(stored(running))
    heads = stored(at.where("figure = ''").join(running, ["packet_id", "like"]).select("page_key", "line_no"))
    # a page number is the outermost line, running lines aside
    inner = at.join(heads, ["page_key", "line_no"], "left_anti")
    top, bottom = Window.partitionBy("page_key").orderBy("line_no"), Window.partitionBy("page_key").orderBy(F.desc("line_no"))
    outer = inner.withColumn("from_top", F.row_number().over(top)).withColumn("from_bottom", F.row_number().over(bottom))
    whole = F.col("k") < EDGE
    outer = outer.where("figure <> ''").where(((F.col("from_top") == 1) & whole) | (F.col("from_bottom") == 1))
    valued = outer.withColumn("value", _number("figure")).where("value is not null").withColumn("offset", F.col("value") - F.col("page_number"))
    steady = valued.withColumn("same", F.size(F.collect_set("page_key").over(Window.partitionBy("packet_id", "offset"))))
    numbers = steady.where((F.col("same") >= 2) | ~F.col("line").rlike(_BARE) | (F.col("value") < 1000))
    return heads.withColumn("noise", F.lit("header")).unionByName(numbers.select("page_key", "line_no", F.lit("page_number").alias("noise")))


def stream_key() -> Column:
    return F.format_string("%s_page_%04d", "stream_id", F.col("original_position") + 1)


def sources(extractions: DataFrame, stream: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scanned pages, all pages of packets, and stream pages, each as ``page_key, text`` and more."""
    e = extractions.select(F.col("page_id").alias("page_key"), "packet_id", "page_number", F.col("text").cast("string").alias("text"), (F.lower(strip("extraction_method")) == "ocr").alias("scanned")).distinct()
    s = stream.where("stream_id is not null and original_position is not null").select(stream_key().alias("page_key"), F.col("text").cast("string").alias("text"))
    return e.where("scanned"), e, s


def _evidence(extractions: DataFrame, stream: DataFrame):
    """Corrections and the looked-up events of scanned and stream pages."""
    scanned, packets, streams = sources(extractions, stream)
    spark = stream.sparkSession
    counts = word_counts(packets.select("text").unionByName(streams.select("text")))
    fixes = corrections(counts)
    n_fixes = fixes.count()
    top = counts.where((F.col("n") >= FREQUENT) & F.col("word").rlike(r"^\p{L}+$")).join(small_or_shuffled(fixes, n_fixes), "word", "left_anti")
    common = frozenset(r[0] for r in top.orderBy(F.desc("n"), "word").limit(COMMON_WORDS).select("word").collect())
    pages = scanned.select("page_key", "text").unionByName(streams)
    schema = "page_key string, line_no int, kind string, a string, b string, other_line int"
    events = stored(pages.where("page_key is not null and text is not null").mapInArrow(_events(spark.sparkContext.broadcast(common)), schema).distinct())
    return packets, counts, fixes, n_fixes, events


def _broken(events: DataFrame, counts: DataFrame, fixes: DataFrame, n_fixes: int) -> DataFrame:
    """Broken words with both fragments, the line of the second, and the word meant."""
    b = events.where("kind = 'break'").withColumn("joined", F.concat("a", "b")).withColumn("compound", F.concat_ws("-", "a", "b"))
    wanted = b.select(F.explode(F.array("joined", "compound", "a", "b")).alias("word")).distinct()
    known = small_or_shuffled(stored(counts.join(small_or_shuffled(stored(wanted)), "word", "left_semi")))
    n = lambda df, c: df.join(known.select(F.col("word").alias(c), F.col("n").alias(f"n_{c}")), c, "left").fillna(0, [f"n_{c}"])
    for c in ("joined", "compound", "a", "b"):
        b = n(b, c)
    b = b.join(small_or_shuffled(fixes, n_fixes).select(F.col("word").alias("joined"), F.col("correct").alias("meant")), "joined", "left")
    soft_or_odd = (F.col("n_a") < FREQUENT) | (F.col("n_b") < FREQUENT)
    good = (F.col("b") != "") & ((F.col("n_joined") > F.col("n_compound")) | (F.col("meant").isNotNull() & (F.col("n_compound") == 0)))
    unknown = (F.col("b") != "") & (F.col("n_joined") == 0) & (F.col("n_compound") == 0) & soft_or_odd & F.col("b").rlike(r"^\p{Ll}")
    alone = (F.col("b") == "") & F.col("other_line").isNull() & (F.col("n_a") < FREQUENT)
    compound = F.max(((F.col("n_compound") >= F.col("n_joined")) & (F.col("n_compound") > 0)).cast("int")).over(Window.partitionBy("page_key", "line_no"))
    rank = F.when(good, 1).when(unknown, 2).when(alone, 3)
    b = b.withColumn("is_compound", compound).withColumn("rank", rank).where(F.col("rank").isNotNull() & ((F.col("rank") == 1) | (F.col("is_compound") == 0)))
    first = Window.partitionBy("page_key", "line_no").orderBy("rank", "other_line", "b")
    return stored(b.withColumn("r", F.row_number().over(first)).where("r = 1").select("page_key", "line_no", "other_line", "a", "b", F.coalesce("meant", "joined").alias("meant"), F.col("meant").isNotNull().alias("misread")))


def scan_noise(extractions: DataFrame, stream: DataFrame) -> DataFrame:
    """Distinct ``page_key, line_no, noise`` with noise hyphen, chars, header or page_number.

    Pages of ``extractions`` count where the method, trimmed and lower-cased, is ocr, with all
    four kinds; pages of ``stream`` for hyphen and chars. Nulls: pages without key or text
    have no lines, blank texts no noise. Repeated rows count once in the result; in the word
    counts they weigh as often as they stand there. Very long texts are read whole. Empty
    tables give an empty result. Only the named columns are read.
    """
    packets, counts, fixes, n_fixes, events = _evidence(extractions, stream)
    broken = _broken(events, counts, fixes, n_fixes)
    small = small_or_shuffled(fixes.select(F.col("word").alias("a"), "correct"), n_fixes)
    words = events.where("kind = 'word'").join(small, "a").select("page_key", "line_no")
    split_words = small_or_shuffled(broken.select("page_key", F.col("line_no").alias("from")))
    rest = events.where("kind = 'rest'").join(small, "a")
    rest = rest.join(split_words, (rest["page_key"] == split_words["page_key"]) & (rest["other_line"] == split_words["from"]), "left_anti").select("page_key", "line_no")
    head = broken.where("misread and not startswith(meant, a)").select("page_key", "line_no")
    tail = broken.where("misread and not endswith(meant, b)").select("page_key", F.col("other_line").alias("line_no"))
    chars = words.unionByName(rest).unionByName(head).unionByName(tail).withColumn("noise", F.lit("chars"))
    scanned = packets.where("scanned").select("page_key").distinct()
    furnished = furniture(packets.where("page_key is not null and packet_id is not null"))
    edge = furnished.join(scanned, "page_key", "left_semi")
    return chars.unionByName(broken.select("page_key", "line_no", F.lit("hyphen").alias("noise"))).unionByName(edge).distinct()


def _like(seen: str, correct: str) -> str:
    """The correct word written as the misread one was: in capitals, capitalised, or small."""
    letters = [c for c in seen if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return correct.upper()
    return correct.capitalize() if seen[:1].isupper() or (not seen[:1].isalpha() and letters and letters[0].isupper()) else correct


def repair_page(text: str, drop: set[int], fixes: dict[int, dict[str, str]], breaks: dict[int, tuple[int | None, str, str]], flow: bool) -> str:
    """Text of one page without its furniture, with words corrected and broken ones joined.

    ``flow`` joins lines to paragraphs: one ends at a blank line, before a list line, and after
    a line that ends a sentence well before the longest line does.
    """
    lines = page_lines(text)
    for i, (other, start, meant) in breaks.items():
        if i < len(lines) and other is not None and other < len(lines):
            tail = _BROKEN.search(lines[i])
            first = _FIRST.match(lines[other])
            if tail and first:
                lines[i] = lines[i][: tail.start(1)] + _like(tail.group(1), meant) + lines[other][first.start(1) + len(start) :][: _trailing(lines[other], first.start(1) + len(start))]
                lines[other] = lines[other][first.start(1) + len(start) :][_trailing(lines[other], first.start(1) + len(start)) :].lstrip()
    for i, words in fixes.items():
        if i < len(lines):
            for seen, correct in words.items():
                lines[i] = re.sub(r"(?<![^\s\-‐\xad¬—.,;:?()\"'|/\[\]])" + re.escape(seen) + r"(?![^\s\-‐\xad¬—.,;:?()\"'|/\[\]])", lambda m, c=correct: _like(m.group(0), c), lines[i], flags=re.I)
    kept = [x.rstrip() for i, x in enumerate(lines) if i not in drop]
    if not flow:
        return "\n".join(kept)
    widest = max((len(x) for x in kept), default=0)
    out: list[str] = []
    open_paragraph = False
    for x in kept:
        if not x.strip():
            open_paragraph = False
            continue
        listed = re.match(r"\s*(-|\*|•|\d+[.)])\s+", x) or re.search(r"\s{2,}\S", x.strip())
        if open_paragraph and not listed:
            out[-1] += " " + x.strip()
        else:
            out.append(x.strip())
        open_paragraph = not listed and not (len(x) < 0.8 * widest and x.rstrip()[-1] in ".?!:")
    return "\n".join(out)


def _trailing(line: str, at: int) -> int:
    """Length of the punctuation that belongs to the word that ends at ``at``."""
    n = 0
    while at + n < len(line) and not line[at + n].isspace():
        n += 1
    return n


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            fixes: dict[int, dict[str, str]] = {}
            for f in row["fixes"] or []:
                fixes.setdefault(f["line_no"], {})[f["a"]] = f["correct"]
            breaks = {b["line_no"]: (b["other_line"], b["b"], b["meant"]) for b in row["breaks"] or []}
            drop = set(row["drop"] or []) if row["scanned"] else set()
            out.append(repair_page(row["text"] or "", drop, fixes, breaks, row["scanned"]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["page_key", "text"])


def repaired_text(extractions: DataFrame, stream: DataFrame, unmarked: bool = False) -> DataFrame:
    """``page_key, text`` of scanned pages as paragraphs without furniture, and of stream pages with
    misread and broken words repaired. With ``unmarked``, a stream page with such words counts as
    scanned and becomes paragraphs without furniture too, its stream being the packet; without,
    stream pages keep their lines. A null text becomes empty; other cases as in ``scan_noise``.
    Pages of one key with different texts are each repaired by the findings of all.
    """
    packets, counts, fixes, n_fixes, events = _evidence(extractions, stream)
    broken = _broken(events, counts, fixes, n_fixes)
    small = small_or_shuffled(fixes.select(F.col("word").alias("a"), "correct"), n_fixes)
    words = events.where("kind in ('word', 'rest')").join(small, "a")
    scanned, _, streams = sources(extractions, stream)
    pages = scanned.select("page_key", "text", F.lit(True).alias("marked")).unionByName(streams.select("page_key", "text", F.lit(False).alias("marked"))).where("page_key is not null").distinct()
    fix = words.groupBy("page_key").agg(F.collect_set(F.struct("line_no", "a", "correct")).alias("fixes"))
    join = broken.groupBy("page_key").agg(F.collect_set(F.struct("line_no", "other_line", "b", "meant")).alias("breaks"))
    found = stored(fix.join(join, "page_key", "full"))
    drop = furniture(packets.where("page_key is not null and packet_id is not null")).withColumn("marked", F.lit(True))
    flow = F.col("marked")
    if unmarked:
        # a stream without a scanned page has nothing to take out
        streamed = stream.where("stream_id is not null and original_position is not null")
        streamed = streamed.select(stream_key().alias("page_key"), F.col("stream_id").alias("packet_id"), (F.col("original_position") + 1).alias("page_number"), F.col("text").cast("string").alias("text")).distinct()
        with_scans = stored(streamed.join(found, "page_key", "left_semi").select("packet_id").distinct())
        streamed = streamed.join(small_or_shuffled(with_scans), "packet_id", "left_semi")
        drop = drop.unionByName(furniture(streamed).withColumn("marked", F.lit(False)))
        flow = flow | F.col("fixes").isNotNull() | F.col("breaks").isNotNull()
    drop = drop.groupBy("page_key", "marked").agg(F.collect_set("line_no").alias("drop"))
    whole = pages.join(found, "page_key", "left").join(drop, ["page_key", "marked"], "left")
    whole = whole.select("page_key", "text", "fixes", "breaks", "drop", flow.alias("scanned"))
    return whole.mapInArrow(_repair, "page_key string, text string")


def p6_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "page_extractions", "page_id", "packet_id", "page_number", "text", "extraction_method")
    return repaired_text(pages, table(spark, folder, "stream_pages", "stream_id", "original_position", "text"), unmarked=True)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "page_extractions", "page_id", "packet_id", "page_number", "text", "extraction_method")
    return scan_noise(pages, table(spark, folder, "stream_pages", "stream_id", "original_position", "text"))


QUERIES = {"p6_found": p6_found, "p6_text": p6_text}
SQL: dict[str, str] = {}
