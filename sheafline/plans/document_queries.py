"""Queries over structured documents, chunks, retrieval and sample layouts; and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.operators import boundaries as B
from sheafline.operators import boundary_model as M
from sheafline.operators import chunking as C
from sheafline.operators import page_types as T
from sheafline.operators import retrieval as R
from sheafline.operators import sample_layouts as L
from sheafline.operators import structure as S
from sheafline.plans.storage import small_or_shuffled, stored
from sheafline.plans.stream_queries import _TRUE, _bucket, _pages
from sheafline.sources.tables import schema_summary, table


def _extractions(spark, folder):
    rows = table(spark, folder, "page_extractions", "page_id", "packet_id", "page_number", "text", "blocks")
    return rows.withColumn("h", F.xxhash64("text", "blocks")).dropDuplicates(["page_id", "h"]).drop("h")


def content_blocks(spark, folder):
    b = S.content_blocks(_extractions(spark, folder))
    rows = F.array_join(F.transform("block.rows", lambda r: F.array_join(r, "|")), "\n")
    return b.select("page_id", "block_no", F.col("block.type").alias("type"), F.col("block.text").alias("text"), F.array_join("block.headers", "|").alias("headers"), rows.alias("rows"), F.array_join("block.items", "\n").alias("items"), F.array_join(F.transform("block.bbox", lambda x: F.round(x, 3).cast("decimal(12,3)").cast("string")), ",").alias("bbox"), F.col("block.source_block_count").alias("source_blocks"))


def packet_sections(spark, folder):
    return S.sections(S.content_blocks(_extractions(spark, folder)), "packet_id")


def packet_titles(spark, folder):
    pages = _extractions(spark, folder)
    return S.titles(S.content_blocks(pages), pages, "packet_id")


def _structured(spark, folder):
    return table(spark, folder, "structured_documents", "document_id", "document_type", "content", "source", "metadata")


def stage2_metrics(spark, folder):
    d = _structured(spark, folder).select("document_id", "content", "source", F.col("metadata.page_count").alias("page_count"), F.xxhash64("content", "source").alias("h")).dropDuplicates(["document_id", "h"])
    secs = F.coalesce("content.sections", F.array().cast(d.schema["content"].dataType["sections"].dataType))
    blocks = F.flatten(F.transform(F.filter(secs, lambda s: s.isNotNull()), lambda s: F.filter(F.coalesce(s["blocks"], F.array().cast(d.schema["content"].dataType["sections"].dataType.elementType["blocks"].dataType)), lambda b: b.isNotNull())))
    d = d.select(F.size(secs).alias("s"), blocks.alias("b"), F.coalesce((F.col("source.page_start") <= F.col("source.page_end")) & (F.col("page_count") > 0), F.lit(False)).alias("ok"))
    kind = lambda k: F.sum(F.size(F.filter("b", lambda b: b["type"] == k)))
    return d.agg(F.count("*").alias("documents"), F.round(F.avg("s"), 6).alias("sections_per_document"), F.round(F.avg(F.size("b")), 6).alias("blocks_per_document"), kind("table").alias("tables"), kind("figure").alias("figures"), F.sum(F.col("ok").cast("int")).alias("provenance_ok"))


def document_chunks(spark, folder):
    return C.chunks(_structured(spark, folder))


def char_windows(spark, folder):
    d = table(spark, folder, "documents", "doc_id", "text").where("text is not null").distinct()
    return d.select("doc_id", F.posexplode(C.windows(F.col("text"))).alias("part", "window"))


def _embeddings(spark, folder):
    e = table(spark, folder, "embeddings", "vec_id", "embedding", "label")
    return e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("document_type"))


def _found(spark, folder):
    """Top-N of every vector whose id is divisible by 100, against all vectors, with types of both."""
    e = _embeddings(spark, folder)
    q = e.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vector", F.col("document_type").alias("query_type"))
    found = R.dense_search(q.select("query_id", "vector"), e)
    return found.join(e.select("chunk_id", "document_type"), "chunk_id").join(small_or_shuffled(stored(q.select("query_id", "query_type"))), "query_id")


def vector_topn(spark, folder):
    return _found(spark, folder).select("query_id", "chunk_id", "score", "rank")


def type_postfilter(spark, folder):
    f = _found(spark, folder).where("document_type = query_type")
    return R.evidence(f).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def _chunks(spark, folder):
    v = table(spark, folder, "documents", "doc_id", "document_type", "text").where("text is not null").distinct()
    return v.withColumnRenamed("doc_id", "chunk_id")


def _queries(spark, folder):
    """Starts of the documents whose id is divisible by 100, asked against all documents."""
    d = _chunks(spark, folder).where("chunk_id % 100 = 0")
    query = R.normalize_query(F.substring("text", 1, 200))
    return d.select(F.col("chunk_id").alias("query_id"), query.alias("query"), F.substring("text", 1, 30).alias("match_text"), "document_type").where("query <> ''")


def _text_found(spark, folder):
    c = _chunks(spark, folder)
    index = stored(R.hash_index(c.select("chunk_id", "text"), "chunk_id"))
    q = _queries(spark, folder)
    asked = stored(R.hash_index(q.select("query_id", F.col("query").alias("text")), "query_id"))
    return stored(R.search(asked, index, c)), q, c


def hash_embedding(spark, folder):
    v = table(spark, folder, "vector_records", "chunk_id", "text").where("text is not null").distinct()
    return R.hash_index(v, "chunk_id").select("chunk_id", "bucket", F.round("weight", 6).alias("weight"))


def evidence_topk(spark, folder):
    found, _, _ = _text_found(spark, folder)
    return R.evidence(found).select("query_id", "chunk_id", "vector_score", F.round("score", 6).alias("score"), "rank")


def rerank_combined(spark, folder):
    found, q, c = _text_found(spark, folder)
    texts = found.join(c.select("chunk_id", "text"), "chunk_id").join(small_or_shuffled(stored(q.select("query_id", "query"))), "query_id")
    e = R.evidence(texts, rerank=R.token_overlap("query", "text"))
    return e.select("query_id", "chunk_id", "vector_score", F.round("rerank_score", 6).alias("rerank_score"), F.round("score", 6).alias("score"), "rank")


def relevant_chunks(spark, folder):
    return R.relevant(_chunks(spark, folder), _queries(spark, folder).where("document_type is not null"))


def _per_query(spark, folder):
    found, q, c = _text_found(spark, folder)
    return R.query_metrics(R.evidence(found), R.relevant(c, q.where("document_type is not null")))


_NAMES = ("recall_1", "recall_3", "recall_5", "precision_1", "precision_5", "mrr", "ndcg")


def query_metrics(spark, folder):
    return _per_query(spark, folder).select("query_id", "relevant", *[F.round(c, 6).alias(c) for c in _NAMES], "top1")


def retrieval_metrics(spark, folder):
    return _per_query(spark, folder).agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in _NAMES], F.round(F.avg("top1"), 6).alias("top1"))


def type_prototypes(spark, folder):
    p = T.prototypes(_embeddings(spark, folder), "document_type", "vector")
    return p.select("label", "dim", F.round("value", 6).alias("value"))


def prototype_types(spark, folder):
    e = _embeddings(spark, folder)
    n = T.nearest_prototype(e, stored(T.prototypes(e, "document_type", "vector")), "chunk_id", "vector")
    return n.select("key", "document_type", F.round("confidence", 6).alias("confidence"))


def _sampled(spark, folder):
    """Packet samples in all layouts, made of the true groups of the page streams."""
    p = B.true_groups(_pages(spark, folder)).join(_pages(spark, folder).select("stream_id", "page_number", "source"), ["stream_id", "page_number"])
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "group_no", "source")))
    g = p.groupBy("stream_id").agg(ordered.alias("x"))
    last = F.filter(F.transform("x", lambda y, i: F.when(F.coalesce(F.get("x", i + 1)["group_no"], F.lit(-1)) != y["group_no"], y["page_number"])), lambda y: y.isNotNull())
    return g.select(
        F.col("stream_id").alias("packet_id"), F.size("x").alias("num_pages"), F.slice(last, F.lit(1), F.greatest(F.size(last) - 1, F.lit(0))).alias("boundaries"), F.transform("x", lambda y: y["group_no"] % 2).alias("labels"),
        F.transform("x", lambda y: y["source"]).alias("page_labels"), F.transform("x", lambda y: y["group_no"] % 3).alias("document_ids"),
        F.transform(F.array_distinct(F.transform("x", lambda y: y["group_no"])), lambda n: F.struct(F.transform(F.filter("x", lambda y: y["group_no"] == n), lambda y: y["page_number"]).alias("pages"), F.when(n % 2 == 0, F.lit("even")).alias("document_type"))).alias("documents"),
    )


def _layout(operator):
    return lambda spark, folder: operator(_sampled(spark, folder))


def sample_annotations(spark, folder):
    """One row a packet: groups and types as texts."""
    samples = _sampled(spark, folder)
    a = L.annotations(samples, L.documents_layout(samples))
    return a.select("packet_id", "page_count", F.array_join(F.transform("groups", lambda g: F.array_join(g, ",")), ";").alias("groups"), F.array_join("document_types", ",").alias("document_types"))


def first_training_streams(spark, folder, n=25):
    """The training streams that were received first, with their pages."""
    train = table(spark, folder, "stream_splits", "stream_id", "split_name").where("lower(trim(split_name)) = 'train'").select("stream_id").distinct()
    pages = table(spark, folder, "stream_pages", "stream_id", "original_position", "received_at").join(train, "stream_id", "left_semi")
    return M.first_streams(pages, n).groupBy("stream_id").agg(F.countDistinct("original_position").alias("pages"))


#: Tables of the packet data whose schemas are listed.
TABLES = ("stream_pages", "stream_splits", "page_extractions", "structured_documents", "raw_records", "vector_records", "documents", "eval_items")


def table_fields(spark, folder):
    return reduce(DataFrame.unionByName, (schema_summary(table(spark, folder, t), t) for t in TABLES)).drop("type")


def _learned(spark, folder):
    """Model of the training streams, the pages and features of all streams, their splits, and the pairs kept for validation."""
    pages = _pages(spark, folder)
    features = stored(B.pair_features(B.text_pages(pages)))
    splits = table(spark, folder, "stream_splits", "stream_id", "split_name").select("stream_id", F.lower(F.trim("split_name")).alias("split")).distinct()
    pairs = M.training_pairs(features, B.true_pairs(pages)).join(splits.where("split = 'train'").select("stream_id"), "stream_id")
    fitted, kept = M.divided(pairs)
    return M.train(stored(fitted)), pages, features, splits, kept


def learned_decisions(spark, folder):
    model, _, features, *_ = _learned(spark, folder)
    return M.learned_decisions(features, model)


def learned_metrics(spark, folder):
    """Macro metrics of the learned method over the streams of each split."""
    model, pages, features, splits, _ = _learned(spark, folder)
    per = stored(B.stream_metrics(pages, M.learned_decisions(features, model)).join(splits, "stream_id"))
    out = None
    for name in ("train", "validation", "test"):
        m = B.macro(per.where(F.col("split") == name), "learned").withColumn("split", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out


def learned_validation(spark, folder):
    """Confusion of the learned method on the training pairs that were kept back."""
    model, *_, kept = _learned(spark, folder)
    return M.validation_counts(model, kept)


def feature_importance(spark, folder):
    model = _learned(spark, folder)[0]
    return spark.createDataFrame(list(M.importances(model).items()), "feature string, importance double")


QUERIES = {
    "content_blocks": content_blocks,
    "packet_sections": packet_sections,
    "packet_titles": packet_titles,
    "stage2_metrics": stage2_metrics,
    "document_chunks": document_chunks,
    "char_windows": char_windows,
    "vector_topn": vector_topn,
    "type_postfilter": type_postfilter,
    "hash_embedding": hash_embedding,
    "evidence_topk": evidence_topk,
    "rerank_combined": rerank_combined,
    "relevant_chunks": relevant_chunks,
    "query_metrics": query_metrics,
    "retrieval_metrics": retrieval_metrics,
    "type_prototypes": type_prototypes,
    "prototype_types": prototype_types,
    "layout_documents": _layout(L.documents_layout),
    "layout_labelled_pages": _layout(L.labelled_pages_layout),
    "layout_boundaries": _layout(L.boundaries_layout),
    "layout_labels": _layout(L.labels_layout),
    "sample_annotations": sample_annotations,
    "first_training_streams": first_training_streams,
    "table_fields": table_fields,
    "learned_decisions": learned_decisions,
    "learned_validation": learned_validation,
    "learned_metrics": learned_metrics,
    "feature_importance": feature_importance,
}

_W = r"[\s\x0B\x{85}\x{A0}]"
_strip = lambda x: rf"regexp_replace({x}, '^{_W}+|{_W}+$', '', 'g')"
_cols = lambda x: rf"list_filter(list_transform(regexp_split_to_array(regexp_replace({_strip(x)}, '^\|+|\|+$', '', 'g'), '{_W}{{2,}}|\t+|\|'), lambda c: {_strip('c')}), lambda c: c <> '')"
_BLOCKS = rf"""
e as (select distinct page_id, packet_id, page_number, text, blocks from page_extractions),
u as (select page_id, packet_id, page_number, unnest(blocks) b, unnest(range(len(blocks))) k from e where len(blocks) > 0),
f as (select *, {_cols('b.text')} c, regexp_matches({_strip('b.text')}, '^(-|\*|•|\d+[.)]){_W}+') l, coalesce(b.block_type = 'image', false) im, coalesce(b.is_heading, false) hd from u),
t as (select *, len(c) >= 2 and not im and not hd t from f),
tr as (select *, k - row_number() over (partition by page_id, t order by k) g from t),
tn as (select *, t and count(*) over (partition by page_id, t, g) >= 2 tab from tr),
lr as (select *, l and not tab and not im lis from tn),
ln as (select *, case when tab then 't' || g when lis then 'l' || (k - row_number() over (partition by page_id, lis order by k)) else 's' || k end run from lr),
gr as (select page_id, packet_id, page_number, run, min(k) k0, count(*) n, max(len(c)) w, list(c order by k) cs, list({_strip('b.text')} order by k) items, any_value(b) b, min(b.x0) x0, min(b.y0) y0, max(b.x1) x1, max(b.y1) y1, bool_or(im) im, bool_or(hd) hd, bool_or(tab) tab, bool_or(lis) lis from ln group by page_id, packet_id, page_number, run),
pd as (select *, list_transform(cs, lambda r: list_concat(r, list_transform(range(w - len(r)), lambda z: ''))) ps from gr),
cb as (select page_id, packet_id, page_number, cast(row_number() over (partition by page_id order by k0) - 1 as int) block_no,
       case when tab then 'table' when lis then 'list' when im then 'figure' when hd then 'heading' else 'paragraph' end as type,
       case when tab then list_aggregate(list_transform(ps, lambda r: list_aggregate(r, 'string_agg', ' | ')), 'string_agg', chr(10)) when lis then list_aggregate(items, 'string_agg', chr(10))
            when im and coalesce(b.text, '') = '' then 'Figure on page ' || page_number else b.text end as text,
       case when tab then list_aggregate(ps[1], 'string_agg', '|') end headers, case when tab then list_aggregate(list_transform(ps[2:], lambda r: list_aggregate(r, 'string_agg', '|')), 'string_agg', chr(10)) end as rows,
       case when lis then list_aggregate(items, 'string_agg', chr(10)) end items,
       cast(round(x0, 3)::decimal(12,3) as varchar) || ',' || cast(round(y0, 3)::decimal(12,3) as varchar) || ',' || cast(round(x1, 3)::decimal(12,3) as varchar) || ',' || cast(round(y1, 3)::decimal(12,3) as varchar) bbox,
       case when tab or lis then cast(n as int) end source_blocks from pd
       union all select page_id, packet_id, page_number, 0, 'paragraph', {_strip('text')}, null, null, null, null, null from e where coalesce(len(blocks), 0) = 0 and {_strip("coalesce(text, '')")} <> ''),
sc as (select *, sum(case when type = 'heading' then 1 else 0 end) over (partition by packet_id order by page_number, page_id, block_no) s from cb),
sg as (select packet_id, cast(s as int) section_no, max(case when type = 'heading' then text end) heading, arg_min(page_number, (page_number, page_id, block_no)) as page, count(*) filter (where type <> 'heading') block_count from sc group by packet_id, s),
sk as (select * exclude (last) from (select *, max(section_no) over (partition by packet_id) as last from sg) where block_count > 0 or (section_no = last and coalesce(heading, '') <> ''))"""
_SD = """
d as (select document_id, document_type, content, source, metadata, row_number() over (partition by document_id, content::varchar) z from structured_documents),
dd as (select * from d where z = 1),
s as (select document_id, document_type, unnest(content.sections) s, unnest(range(len(content.sections))) sn from dd where content is not null),
bl as (select document_id, document_type, sn, s.heading heading, unnest(s.blocks) b, unnest(range(len(s.blocks))) bn from s where s is not null),
bt as (select *, case when b.type = 'table' and len(b.headers) > 0 and len(b.rows) > 0 then list_aggregate(list_concat([list_aggregate(list_transform(b.headers, lambda x: coalesce(x, '')), 'string_agg', ' | ')],
         list_transform(list_filter(b.rows, lambda r: r is not null), lambda r: coalesce(list_aggregate(list_transform(r, lambda x: coalesce(x, '')), 'string_agg', ' | '), ''))), 'string_agg', chr(10))
       when b.type = 'list' and len(b.items) > 0 then coalesce(list_aggregate(list_filter(b.items, lambda x: x is not null), 'string_agg', chr(10)), '')
       when b.type = 'figure' and coalesce(b.text, '') = '' then 'Figure' else coalesce(b.text, '') end t from bl where b is not null)"""
_E = "e as (select vec_id, cast(embedding as double[64]) v, cast(label as varchar) label from embeddings where embedding is not null), sc as (select q.vec_id query_id, c.vec_id chunk_id, q.label ql, c.label cl, round(array_inner_product(q.v, c.v), 6) score from e q, e c where q.vec_id % 100 = 0), tn as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from sc) where rank <= 50)"
_mm = lambda x, w: f"case when min({x}) over {w} = max({x}) over {w} then 1.0 else ({x} - min({x}) over {w}) / (max({x}) over {w} - min({x}) over {w}) end"
_Q = "(partition by query_id)"
_SPLIT = r"regexp_split_to_array(lower({x}), '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+')"


def _index(name: str, source: str, key: str, text: str) -> str:
    return f"{name}w as (select {key}, unnest({_SPLIT.replace('{x}', text)}) w from {source}), {name}c as (select {key}, {_bucket('w')} bucket, count(*) n from {name}w where w <> '' group by all), {name} as (select {key}, bucket, n / sqrt(sum(n * n) over (partition by {key})) weight from {name}c)"


_FOUND = (
    "c as (select distinct doc_id chunk_id, document_type, text from documents where text is not null), "
    + r"q as (select * from (select chunk_id query_id, regexp_replace(" + _strip("substr(text, 1, 200)") + rf", '{_W}+', ' ', 'g') query, substr(text, 1, 30) match_text, document_type from c where chunk_id % 100 = 0) where query <> ''), "
    + _index("ci", "c", "chunk_id", "text") + ", " + _index("qi", "q", "query_id", "query")
    + """, h as (select query_id, chunk_id, round(sum(a.weight * b.weight), 6) score from qi a join ci b using (bucket) group by all),
    z as (select query_id, chunk_id, coalesce(score, 0) score from (select distinct query_id from qi) cross join (select distinct chunk_id from c) left join h using (query_id, chunk_id)),
    tn as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from z) where rank <= 50),
    rl as (select distinct query_id, chunk_id from c join (select query_id, document_type, lower(match_text) m from q) using (document_type) where contains(lower(text), m))"""
)
_PER_QUERY = f"""with {_FOUND}, ev as (select * from tn where rank <= 5), ht as (select ev.query_id, ev.rank, case when rl.chunk_id is null then 0 else 1 end hit from ev left join rl using (query_id, chunk_id)),
  rn as (select query_id, count(*) relevant from rl group by query_id),
  ag as (select query_id, sum(hit) filter (where rank <= 1) h1, sum(hit) filter (where rank <= 3) h3, sum(hit) h5, min(rank) filter (where hit = 1) first, sum(hit / log2(rank + 1)) dcg from ht group by query_id),
  pq as (select query_id, coalesce(relevant, 0) relevant, coalesce(h1::double / nullif(relevant, 0), 0) recall_1, coalesce(h3::double / nullif(relevant, 0), 0) recall_3, coalesce(h5::double / nullif(relevant, 0), 0) recall_5, h1 / 1.0 precision_1, h5 / 5.0 precision_5,
         coalesce(1.0 / first, 0) mrr, case when h5 > 0 then dcg / list_sum(list_transform(range(1, cast(h5 as int) + 1), lambda i: 1 / log2(i + 1))) else 0 end ndcg, case when first = 1 then 1 else 0 end top1 from ag left join rn using (query_id))"""
_LAY = _TRUE + ", x as (select tg.stream_id packet_id, page_number, group_no, p.source from tg join p using (stream_id, page_number))"

SQL = {
    "content_blocks": f"with {_BLOCKS} select page_id, block_no, type, text, headers, rows, items, bbox, source_blocks from cb",
    "packet_sections": f"with {_BLOCKS} select packet_id, section_no, heading, page, block_count from sk",
    "packet_titles": f"""with {_BLOCKS}, h as (select packet_id, arg_min(coalesce(heading, ''), section_no) heading from sk group by packet_id),
        l as (select packet_id, arg_min(substr(string_split({_strip("coalesce(text, '')")}, chr(10))[1], 1, 200), (page_number, page_id)) line from e group by packet_id)
        select packet_id, coalesce(nullif(heading, ''), nullif(line, '')) title from l left join h using (packet_id)""",
    "stage2_metrics": """with d as (select distinct document_id, content, source, first(metadata.page_count) over (partition by document_id, content::varchar) page_count from structured_documents),
        n as (select coalesce(len(content.sections), 0) s, list_filter(flatten(list_transform(list_filter(coalesce(content.sections, []), lambda s: s is not null), lambda s: coalesce(s.blocks, []))), lambda b: b is not null) b, coalesce(source.page_start <= source.page_end and page_count > 0, false) ok from d)
        select count(*) documents, round(avg(s), 6) sections_per_document, round(avg(len(b)), 6) blocks_per_document, cast(sum(len(list_filter(b, lambda x: x.type = 'table'))) as bigint) tables, cast(sum(len(list_filter(b, lambda x: x.type = 'figure'))) as bigint) figures, count(*) filter (where ok) provenance_ok from n""",
    "document_chunks": f"""with {_SD},
        lb as (select *, {_strip('t')} st, b.type = 'paragraph' and position(chr(10) in {_strip('t')}) = 0 and ends_with({_strip('t')}, ':') and length({_strip('t')}) <= 80 la, row_number() over (partition by document_id, sn order by bn) ap from bt),
        rp as (select *, row_number() over (partition by document_id, sn, la, ap - ir order by bn) pl from (select *, row_number() over (partition by document_id, sn, la order by bn) ir from lb)),
        tk as (select *, la and pl % 2 = 1 and coalesce(lead(st) over w <> '' and lead(b.type) over w not in ('table', 'figure'), false) takes, lead(st) over w nt, lead(b.page) over w np from rp window w as (partition by document_id, sn order by bn)),
        kp as (select * from (select *, coalesce(lag(takes) over (partition by document_id, sn order by bn), false) taken from tk) where not taken and st <> ''),
        pt as (select document_id, document_type, sn, bn, b.page page_start, case when takes then np else b.page end page_end, heading section, case when takes then 'merged' else b.type end block_type, case when takes then st end merged_label, case when takes then st || chr(10) || nt else st end ct from kp),
        pw as (select *, unnest(case when length(ct) <= 1000 then [0] else range(cast(ceil((length(ct) - 100) / 900.0) as int)) end) part from pt),
        mk as (select printf('%s_chunk_%03d', document_id, row_number() over (partition by document_id order by sn, bn, part)) chunk_id, document_id, document_type, page_start, page_end, section, {_strip('substr(ct, part * 900 + 1, 1000)')} as text, block_type, merged_label from pw)
        select * from mk union all
        select distinct printf('%s_chunk_%03d', document_id, 1), document_id, document_type, source.page_start, source.page_end, null, content.title, null, null from dd where coalesce(content.title, '') <> '' and document_id not in (select document_id from mk)""",
    "char_windows": "with d as (select distinct doc_id, text from documents where text is not null), w as (select *, unnest(case when length(text) <= 1000 then [0] else range(cast(ceil((length(text) - 100) / 900.0) as int)) end) part from d) select doc_id, cast(part as int) part, substr(text, part * 900 + 1, 1000) as window from w",
    "vector_topn": f"with {_E} select query_id, chunk_id, score, cast(rank as int) as rank from tn",
    "type_postfilter": f"with {_E}, n as (select query_id, chunk_id, {_mm('score', _Q)} s, row_number() over (partition by query_id order by score desc, chunk_id) as rank from tn where ql = cl) select query_id, chunk_id, round(s, 6) score, cast(rank as int) as rank from n where rank <= 5",
    "hash_embedding": "with v as (select distinct chunk_id, text from vector_records where text is not null), " + _index("i", "v", "chunk_id", "text") + " select chunk_id, cast(bucket as int) bucket, round(weight, 6) weight from i",
    "evidence_topk": f"with {_FOUND}, n as (select query_id, chunk_id, score vector_score, {_mm('score', _Q)} s, rank from tn) select query_id, chunk_id, vector_score, round(s, 6) score, cast(rank as int) as rank from n where rank <= 5",
    "rerank_combined": f"""with {_FOUND}, f as (select tn.*, list_distinct(regexp_extract_all(lower(q.query), '[a-z0-9]+')) a, list_distinct(regexp_extract_all(lower(c.text), '[a-z0-9]+')) b from tn join q using (query_id) join c using (chunk_id) where rank <= 20),
        o as (select *, case when len(a) = 0 then 0.0 else round(len(list_intersect(a, b))::double / len(a), 6) end raw from f), n as (select query_id, chunk_id, score vector_score, rank as ap, {_mm('raw', _Q)} r, {_mm('score', _Q)} v from o),
        k as (select *, row_number() over (partition by query_id order by r desc, ap) as rank from n) select query_id, chunk_id, vector_score, round(r, 6) rerank_score, round(0.4 * v + 0.6 * r, 6) score, cast(rank as int) as rank from k where rank <= 5""",
    "relevant_chunks": f"with {_FOUND} select * from rl",
    "query_metrics": _PER_QUERY + " select query_id, relevant, " + ", ".join(f"round({c}, 6) {c}" for c in _NAMES) + ", top1 from pq",
    "retrieval_metrics": _PER_QUERY + " select count(*) queries, " + ", ".join(f"round(avg({c}), 6) {c}" for c in _NAMES) + ", round(avg(top1), 6) top1 from pq",
    "type_prototypes": "with u as (select cast(label as varchar) label, unnest(embedding) x, unnest(range(len(embedding))) dim from embeddings where label is not null) select label, cast(dim as int) dim, round(avg(x::double), 6) as value from u group by all",
    "prototype_types": "with u as (select cast(label as varchar) label, unnest(embedding) x, unnest(range(len(embedding))) dim from embeddings where label is not null), m as (select label, dim, avg(x::double) x from u group by all), p as (select label, cast(list(x order by dim) as double[64]) p from m group by label), s as (select vec_id, label, array_cosine_similarity(cast(embedding as double[64]), p) c from (select vec_id, embedding from embeddings) cross join p) select vec_id as key, case when greatest(max(c), 0) >= 0.3 then arg_max(label, c) else 'unknown' end document_type, round(least(greatest(max(c), 0), 1), 6) confidence from s group by vec_id",
    "layout_documents": f"with {_LAY} select packet_id, group_no, string_agg(page_number, ',' order by page_number) pages, case when group_no % 2 = 0 then 'even' else 'unknown' end document_type from x group by packet_id, group_no",
    "layout_labelled_pages": f"with {_LAY} select packet_id, cast(group_no % 3 as varchar) document, string_agg(page_number, ',' order by page_number) pages, coalesce(arg_max(source, page_number), 'unknown') document_type from x group by packet_id, group_no % 3",
    "layout_boundaries": f"with {_LAY} select packet_id, group_no, string_agg(page_number, ',' order by page_number) pages, 'unknown' document_type from x group by packet_id, group_no",
    "layout_labels": f"with {_LAY} select packet_id, group_no, string_agg(page_number, ',' order by page_number) pages, cast(group_no % 2 as varchar) document_type from x group by packet_id, group_no",
    "sample_annotations": f"""with {_LAY}, g as (select packet_id, group_no, max(page_number) last, string_agg(page_number, ',' order by page_number) pages from x group by all)
        select packet_id, cast(max(last) as int) page_count, string_agg(pages, ';' order by group_no) groups, string_agg(case when group_no % 2 = 0 then 'even' else 'unknown' end, ',' order by group_no) document_types from g group by packet_id""",
    "first_training_streams": """select stream_id, count(distinct original_position) pages from stream_pages where stream_id in (select stream_id from stream_splits where lower(trim(split_name)) = 'train')
        group by stream_id order by min(received_at) nulls last, stream_id limit 25""",
    "table_fields": " union all ".join(f"select '{t}' table_name, (select count(*) from {t}) num_samples, cast(cid as int) field_no, name field from pragma_table_info('{t}')" for t in TABLES),
}
