"""Queries over page streams: pages, groups, features, decisions, metrics, types; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.functions.text import page_id, short_hash, strip
from sheafline.operators import boundaries as B
from sheafline.operators.page_types import LEXICON, classified
from sheafline.plans.storage import stored
from sheafline.sources.tables import table


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return B.normalized(table(spark, folder, "stream_pages", "stream_id", "original_position", "boundary", "text", "source"))


def _packets(spark: SparkSession, folder: str) -> DataFrame:
    columns = ("packet_id", "page_number", "text", "blocks", "block_count", "image_count", "width", "height")
    return B.layout_pages(table(spark, folder, "page_extractions", *columns))


def _features(spark, folder):
    return B.pair_features(B.text_pages(_pages(spark, folder)))


def stream_pages(spark, folder):
    return _pages(spark, folder).withColumn("page_id", page_id("stream_id", "page_number"))


def stream_annotations(spark, folder):
    g = B.true_groups(_pages(spark, folder)).groupBy("stream_id", "group_no").agg(F.array_join(F.array_sort(F.collect_list("page_number")), ",").alias("pages"), F.count("*").alias("page_count"))
    return g.withColumn("document_type", F.lit("unknown"))


def true_pairs(spark, folder):
    return B.true_pairs(_pages(spark, folder))


def stream_profile(spark, folder):
    p = _pages(spark, folder)
    per = p.groupBy("stream_id").agg(F.count("*").alias("n"), F.sum(F.col("starts_new_document").cast("int")).alias("b"), F.min_by("starts_new_document", "page_number").alias("first"))
    return per.agg(F.sum("n").alias("pages"), F.count("*").alias("streams"), F.min("n").alias("least_pages"), F.max("n").alias("most_pages"), F.round(F.avg("n"), 6).alias("mean_pages"), F.min("b").alias("least_boundaries"), F.max("b").alias("most_boundaries"), F.sum(F.col("first").cast("int")).alias("first_is_boundary"))


def boundary_values(spark, folder):
    rows = table(spark, folder, "stream_pages", "stream_id", "original_position", "boundary").distinct()
    return rows.groupBy(F.col("boundary").cast("int").alias("boundary")).agg(F.count("*").alias("pages"))


def stream_pair_features(spark, folder):
    f = _features(spark, folder)
    return f.select("stream_id", "page_a", "page_b", *[F.round(c, 6).alias(c) for c in B.FEATURES])


def packet_pair_features(spark, folder):
    f = B.pair_features(_packets(spark, folder))
    return f.select("stream_id", "page_a", "page_b", *[F.round(c, 6).alias(c) for c in B.FEATURES])


def _decisions(method):
    def query(spark, folder):
        d = B.decisions(_features(spark, folder), method)
        return d.withColumn("score", F.round("score", 6))

    return query


def predicted_groups(spark, folder):
    p = _pages(spark, folder)
    g = B.groups(B.page_groups(p, B.decisions(B.pair_features(B.text_pages(p)))))
    return g.withColumn("group_confidence", F.round("group_confidence", 6))


def boundary_metrics(spark, folder):
    """Macro means of both methods over all streams; features are made once."""
    p = _pages(spark, folder)
    f = stored(B.pair_features(B.text_pages(p)))
    out = None
    for method in ("baseline", "embedding"):
        m = B.macro(B.stream_metrics(p, B.decisions(f, method)), method)
        out = m if out is None else out.unionByName(m)
    return out.select("method", "streams", "page_pairs", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "grouping_accuracy")])


def stream_boundary_metrics(spark, folder):
    p = _pages(spark, folder)
    m = B.stream_metrics(p, B.decisions(B.pair_features(B.text_pages(p))))
    return m.select("stream_id", "page_pairs", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "grouping_accuracy")])


def page_types(spark, folder):
    return classified(_pages(spark, folder)).select("stream_id", "page_number", "document_type", F.round("confidence", 6).alias("confidence"))


def group_types(spark, folder):
    """Type of each true document from the joined texts of its pages."""
    p = _pages(spark, folder)
    joined = B.true_groups(p).join(p.select("stream_id", "page_number", "text"), ["stream_id", "page_number"])
    texts = joined.groupBy("stream_id", "group_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return classified(texts).select("stream_id", "group_no", "document_type", F.round("confidence", 6).alias("confidence"))


def type_candidates(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text").distinct()
    c = classified(docs).select("doc_id", F.posexplode("candidates").alias("rank", "c"))
    return c.select("doc_id", (F.col("rank") + 1).alias("rank"), F.col("c.type").alias("candidate"), F.round("c.confidence", 6).alias("confidence"))


def _typed_documents(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text", "document_type").distinct().withColumnRenamed("document_type", "truth")
    return classified(docs).withColumnRenamed("document_type", "predicted")


def type_confusion(spark, folder):
    d = _typed_documents(spark, folder).where("truth is not null")
    return d.groupBy("truth", "predicted").agg(F.count("*").alias("documents"))


def type_accuracy(spark, folder):
    d = _typed_documents(spark, folder).where("truth is not null")
    return d.agg(F.count("*").alias("documents"), F.round(F.avg((F.col("truth") == F.col("predicted")).cast("int")), 6).alias("accuracy"))


def ocr_gate(spark, folder):
    """Pages that need recognition: short text, or a warning that there was none."""
    p = table(spark, folder, "page_extractions", "page_id", "text", "warnings").distinct()
    length = F.length(strip(F.coalesce("text", F.lit(""))))
    warned = F.coalesce(F.array_contains("warnings", "empty_native_text"), F.lit(False))
    return p.select("page_id", length.alias("text_length"), ((length < 50) | warned).alias("needs_ocr")).distinct()


def packet_metadata(spark, folder):
    """One row for each packet: pages, the extraction method or mixed, hash of its text, warnings."""
    p = table(spark, folder, "page_extractions", "packet_id", "page_number", "text", "extraction_method", "warnings").distinct()
    method = F.lower(strip("extraction_method"))
    one = p.groupBy("packet_id", "page_number").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.min(method).alias("m"), F.max(method).alias("n"), F.flatten(F.collect_list(F.coalesce("warnings", F.array().cast("array<string>")))).alias("w"))
    g = one.groupBy("packet_id").agg(F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"), F.count("*").alias("page_count"), F.min("m").alias("m"), F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("t"), F.flatten(F.collect_list("w")).alias("w"))
    text = F.array_join(F.transform("t", lambda x: x["text"]), "\n")
    return g.select("packet_id", "page_start", "page_end", "page_count", F.when(F.col("m") == F.col("n"), F.col("m")).otherwise("mixed").alias("extraction_method"), short_hash(text).alias("content_hash"), F.array_join(F.array_sort(F.array_distinct("w")), ",").alias("warnings"))


_P = """p as (select stream_id, cast(row_number() over (partition by stream_id order by original_position, text, starts_new_document, source) as int) page_number, original_position, text, starts_new_document, source
     from (select distinct stream_id, original_position, coalesce(text, '') text, coalesce(boundary = 1, false) starts_new_document, nullif(lower(trim(source)), '') source from stream_pages))"""
_TRUE = _P + """, tg as (select stream_id, page_number, cast(sum(case when starts_new_document and page_number > 1 then 1 else 0 end) over (partition by stream_id order by page_number) + 1 as int) group_no from p),
     tp as (select * from (select stream_id, page_number page_a, lead(page_number) over w page_b, lead(group_no) over w <> group_no is_boundary from tg window w as (partition by stream_id order by page_number)) where page_b is not null)"""


def _hits(name: str) -> str:
    phrases = LEXICON[name]
    return "(" + " + ".join(rf"cast(regexp_matches(low, '\b{p}\b') as int)" for p in phrases) + f") / {len(phrases)}.0"


_TYPE_ROWS = " union all ".join(f"select *, {i} place, '{n}' candidate, {_hits(n)} score from {{t}}" for i, n in enumerate(LEXICON))


def _ranked(source: str, key: str) -> str:
    """CTE of ranked types of ``source(key..., low)``."""
    return f"rk as (select *, row_number() over (partition by {key} order by score desc, place) r from ({_TYPE_ROWS.format(t=source)}) where score > 0)"


def _bucket(word: str) -> str:
    x = lambda a, n: f"cast(('0x' || substr(md5({word}), {a}, {n})) as bigint) % 384"
    return f"({pow(16, 17, 384)} * ({x(1, 15)}) + {pow(16, 2, 384)} * ({x(16, 15)}) + {x(31, 2)}) % 384"


def _ratio(a: str, b: str) -> str:
    return f"case when {a} = 0 and {b} = 0 then 1.0 when {a} = 0 or {b} = 0 then 0.0 else least({a}, {b})::double / greatest({a}, {b}) end"


def _jaccard(a: str, b: str) -> str:
    return f"case when len({a}) = 0 or len({b}) = 0 then 0.0 else len(list_intersect({a}, {b}))::double / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) end"


def _feature_sql(source: str) -> str:
    """Nine features of pages ``source(stream_id, page_number, text, blocks, block_count, image_count, width, height)``."""
    return f"""
w as (select stream_id, page_number, {_bucket('w')} bucket from (select stream_id, page_number, unnest(regexp_split_to_array(lower(text), '[\\s\\x0B\\x1C-\\x1F\\x{{85}}\\x{{A0}}]+')) w from {source}) where w <> ''),
e as (select stream_id, page_number, bucket, count(*) n from w group by all),
nm as (select stream_id, page_number, sqrt(sum(n * n)) nm from e group by all),
cs as (select a.stream_id, a.page_number page_a, sum(a.n * b.n) / any_value(x.nm * y.nm) cosine from e a join e b on a.stream_id = b.stream_id and b.page_number = a.page_number + 1 and a.bucket = b.bucket
       join nm x on x.stream_id = a.stream_id and x.page_number = a.page_number join nm y on y.stream_id = b.stream_id and y.page_number = b.page_number group by all),
q as (select *, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) tk, list_distinct(regexp_extract_all(text, '\\b[A-Z][a-z]+(?:\\s[A-Z][a-z]+)*\\b|\\b\\d{{4,}}\\b|\\$[\\d,.]+')) en,
             length(regexp_replace(text, '^[\\s\\x0B\\x{{85}}\\x{{A0}}]+|[\\s\\x0B\\x{{85}}\\x{{A0}}]+$', '', 'g')) tl, len(list_filter(blocks, lambda z: z.is_heading)) hd, len(blocks) nb,
             list_min(list_transform(blocks, lambda z: z.y0)) y0, list_max(list_transform(blocks, lambda z: z.y0)) y1, list_avg(list_transform(blocks, lambda z: z.x0)) x0, lower(text) low from {source}),
{_ranked('q', 'stream_id, page_number')},
ty as (select stream_id, page_number, candidate from rk where r = 1),
pr as (select a.stream_id, a.page_number page_a, b.page_number page_b, a, b from q a join q b on a.stream_id = b.stream_id and b.page_number = a.page_number + 1),
ft as (select pr.stream_id, pr.page_a, pr.page_b, coalesce(cosine, 0.0) semantic_cosine, {_jaccard('a.tk', 'b.tk')} token_jaccard, {_ratio('a.tl', 'b.tl')} text_length_ratio,
       (({_ratio('a.block_count', 'b.block_count')}) + (({_ratio('trunc(a.width)', 'trunc(b.width)')}) + ({_ratio('trunc(a.height)', 'trunc(b.height)')})) / 2) / 2 layout_similarity,
       case when a.nb = 0 or b.nb = 0 then 0.0 else greatest(0.0, 1 - (abs(a.y0 - b.y0) / 1000 + abs(a.y1 - b.y1) / 1000 + abs(a.x0 - b.x0) / 1000 + abs(a.nb - b.nb) / 50.0 + abs(a.hd / a.nb::double - b.hd / b.nb::double)) / 5) end block_position_similarity,
       {_ratio('a.hd', 'b.hd')} heading_style_similarity, {_jaccard('a.en', 'b.en')} entity_overlap,
       (({_ratio('a.tl', 'b.tl')}) + ({_ratio('a.image_count', 'b.image_count')}) + ({_ratio('a.hd', 'b.hd')})) / 3 structural_similarity,
       case when x.candidate = y.candidate then 1.0 else 0.0 end type_agreement
       from pr left join cs using (stream_id, page_a) left join ty x on x.stream_id = pr.stream_id and x.page_number = pr.page_a left join ty y on y.stream_id = pr.stream_id and y.page_number = pr.page_b)"""


_TEXT_PAGES = _P + ", tx as (select stream_id, page_number, text, cast([] as struct(x0 double, y0 double, is_heading boolean)[]) blocks, 0 block_count, 0 image_count, 0.0 width, 0.0 height from p)"
_ROUNDED = ", ".join(f"round({c}, 6) {c}" for c in B.FEATURES)
_SCORE = "(" + " + ".join(f"{n} * {w / sum(B.WEIGHTS)!r}" for n, w in zip(B.FEATURES, B.WEIGHTS)) + ")"
_STREAM_FEATURES = "with recursive " + _TEXT_PAGES + "," + _feature_sql("tx")
_DECIDED = _STREAM_FEATURES + ", de as (select stream_id, page_a, page_b, round({s}, 9) score, round({s}, 9) < 0.5 is_boundary from ft)"
_METRICS = """, {x}b as (select t.stream_id, t.is_boundary truth, coalesce(d.is_boundary, false) said from tp t left join {x}de d using (stream_id, page_a, page_b)),
  {x}c as (select stream_id, count(*) page_pairs, count(*) filter (where truth and said) tp, count(*) filter (where not truth and said) fp, count(*) filter (where truth and not said) fn from {x}b group by stream_id),
  {x}g as (select p.stream_id, p.page_number, sum(case when d.is_boundary then 1 else 0 end) over (partition by p.stream_id order by p.page_number) + 1 group_no from p left join {x}de d on d.stream_id = p.stream_id and d.page_b = p.page_number),
  {x}a as (select stream_id, avg(case when a.group_no = b.group_no then 1.0 else 0.0 end) grouping_accuracy from tg a join {x}g b using (stream_id, page_number) group by stream_id),
  {x}m as (select *, coalesce(tp::double / nullif(tp + fp, 0), 0) as precision, coalesce(tp::double / nullif(tp + fn, 0), 0) recall, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) f1 from {x}c join {x}a using (stream_id))"""
_BOTH = _DECIDED.replace("{s}", _SCORE).replace(_P, _TRUE)
_FOUR = 'round("precision", 6) "precision", round(recall, 6) recall, round(f1, 6) f1, round(grouping_accuracy, 6) grouping_accuracy'
_FOUR_MEANS = 'round(avg("precision"), 6) "precision", round(avg(recall), 6) recall, round(avg(f1), 6) f1, round(avg(grouping_accuracy), 6) grouping_accuracy'
_EMB = ", ede as (select stream_id, page_a, page_b, round(semantic_cosine, 9) < 0.5 is_boundary from ft)"

QUERIES = {
    "stream_pages": stream_pages,
    "stream_annotations": stream_annotations,
    "true_pairs": true_pairs,
    "stream_profile": stream_profile,
    "boundary_values": boundary_values,
    "stream_pair_features": stream_pair_features,
    "packet_pair_features": packet_pair_features,
    "rule_decisions": _decisions("baseline"),
    "embedding_decisions": _decisions("embedding"),
    "predicted_groups": predicted_groups,
    "boundary_metrics": boundary_metrics,
    "stream_boundary_metrics": stream_boundary_metrics,
    "page_types": page_types,
    "group_types": group_types,
    "type_candidates": type_candidates,
    "type_confusion": type_confusion,
    "type_accuracy": type_accuracy,
    "ocr_gate": ocr_gate,
    "packet_metadata": packet_metadata,
}
_DOCS = "d as (select distinct doc_id, document_type, text, lower(coalesce(text, '')) low from documents), "
SQL = {
    "stream_pages": f"with {_P} select *, printf('%s_page_%04d', stream_id, page_number) page_id from p",
    "stream_annotations": f"with {_TRUE} select stream_id, group_no, string_agg(page_number, ',' order by page_number) pages, count(*) page_count, 'unknown' document_type from tg group by stream_id, group_no",
    "true_pairs": f"with {_TRUE} select * from tp",
    "stream_profile": f"""with {_P}, g as (select stream_id, count(*) n, count(*) filter (where starts_new_document) b, max(case when page_number = 1 and starts_new_document then 1 else 0 end) f from p group by stream_id)
        select cast(sum(n) as bigint) pages, count(*) streams, min(n) least_pages, max(n) most_pages, round(avg(n), 6) mean_pages, min(b) least_boundaries, max(b) most_boundaries, cast(sum(f) as bigint) first_is_boundary from g""",
    "boundary_values": "select cast(boundary as int) boundary, count(*) pages from (select distinct stream_id, original_position, boundary from stream_pages) group by boundary",
    "stream_pair_features": _STREAM_FEATURES + f" select stream_id, page_a, page_b, {_ROUNDED} from ft",
    "packet_pair_features": "with recursive pk as (select distinct packet_id stream_id, page_number, coalesce(text, '') text, coalesce(list_transform(blocks, lambda z: {'x0': z.x0, 'y0': z.y0, 'is_heading': z.is_heading}), []) blocks, coalesce(block_count, 0) block_count, coalesce(image_count, 0) image_count, coalesce(width, 0) width, coalesce(height, 0) height from page_extractions),"
    + _feature_sql("pk").replace("b.page_number = a.page_number + 1", "b.page_number = (select min(z.page_number) from pk z where z.stream_id = a.stream_id and z.page_number > a.page_number)")
    + f" select stream_id, page_a, page_b, {_ROUNDED} from ft",
    "rule_decisions": _DECIDED.replace("{s}", _SCORE) + " select stream_id, page_a, page_b, round(score, 6) score, is_boundary, 'baseline_weighted' as method from de",
    "embedding_decisions": _DECIDED.replace("{s}", "semantic_cosine") + " select stream_id, page_a, page_b, round(score, 6) score, is_boundary, 'baseline_embedding_only' as method from de",
    "predicted_groups": _DECIDED.replace("{s}", _SCORE)
    + """, g as (select p.stream_id, p.page_number, cast(sum(case when is_boundary then 1 else 0 end) over (partition by p.stream_id order by p.page_number) + 1 as int) group_no, case when not is_boundary then score end kept
              from p left join de on de.stream_id = p.stream_id and de.page_b = p.page_number)
         select stream_id, group_no, min(page_number) page_start, max(page_number) page_end, count(*) page_count, string_agg(page_number, ',' order by page_number) pages, round(coalesce(avg(kept), 1.0), 6) group_confidence,
                printf('%s_doc_%03d', stream_id, group_no) document_id from g group by stream_id, group_no""",
    "boundary_metrics": _BOTH + _METRICS.format(x="") + _EMB + _METRICS.format(x="e")
    + f" select 'baseline' as method, count(*) streams, cast(sum(page_pairs) as bigint) page_pairs, {_FOUR_MEANS} from m union all select 'embedding', count(*), cast(sum(page_pairs) as bigint), {_FOUR_MEANS} from em",
    "stream_boundary_metrics": _BOTH + _METRICS.format(x="") + f" select stream_id, page_pairs, tp, fp, fn, {_FOUR} from m",
    "page_types": f"with {_P}, q as (select *, lower(text) low from p), {_ranked('q', 'stream_id, page_number')} select q.stream_id, q.page_number, coalesce(candidate, 'unknown') document_type, round(coalesce(score, 0), 6)::double confidence from q left join rk on rk.stream_id = q.stream_id and rk.page_number = q.page_number and r = 1",
    "group_types": f"with {_TRUE}, q as (select stream_id, group_no, lower(string_agg(text, chr(10) order by page_number)) low from tg join p using (stream_id, page_number) group by all), {_ranked('q', 'stream_id, group_no')} select q.stream_id, q.group_no, coalesce(candidate, 'unknown') document_type, round(coalesce(score, 0), 6)::double confidence from q left join rk on rk.stream_id = q.stream_id and rk.group_no = q.group_no and r = 1",
    "type_candidates": f"with {_DOCS} {_ranked('d', 'doc_id, text')} select doc_id, cast(r as int) as rank, candidate, round(score, 6)::double confidence from rk where r <= 3",
    "type_confusion": f"with {_DOCS} {_ranked('d', 'doc_id, text')} select d.document_type truth, coalesce(candidate, 'unknown') predicted, count(*) documents from d left join rk on rk.doc_id = d.doc_id and r = 1 where d.document_type is not null group by all",
    "type_accuracy": f"with {_DOCS} {_ranked('d', 'doc_id, text')} select count(*) documents, round(avg(case when d.document_type = coalesce(candidate, 'unknown') then 1.0 else 0.0 end), 6) accuracy from d left join rk on rk.doc_id = d.doc_id and r = 1 where d.document_type is not null",
    "ocr_gate": r"""with g as (select distinct page_id, length(regexp_replace(coalesce(text, ''), '^[\s\x0B\x{85}\x{A0}]+|[\s\x0B\x{85}\x{A0}]+$', '', 'g')) n, coalesce(list_contains(warnings, 'empty_native_text'), false) w from page_extractions)
        select distinct page_id, cast(n as int) text_length, n < 50 or w needs_ocr from g""",
    "packet_metadata": """with o as (select packet_id, page_number, min(coalesce(text, '')) t, min(lower(trim(extraction_method))) m, max(lower(trim(extraction_method))) n from page_extractions group by all),
        w as (select packet_id, string_agg(w, ',' order by w) warnings from (select distinct packet_id, unnest(warnings) w from page_extractions) group by packet_id)
        select packet_id, min(page_number) page_start, max(page_number) page_end, count(*) page_count, case when min(m) = max(n) then min(m) else 'mixed' end extraction_method,
               substr(sha256(string_agg(t, chr(10) order by page_number)), 1, 16) content_hash, coalesce(any_value(warnings), '') warnings from o left join w using (packet_id) group by packet_id""",
}
