import itertools

from pyspark.sql import functions as F

from sheafline.operators import chunking as C
from sheafline.operators import structure as S
from sheafline.sources.schemas import BLOCK, DOCUMENT

PAGES = f"page_id string, packet_id string, page_number int, text string, blocks array<{BLOCK}>"


def block(text, kind="text", heading=False, y=0):
    return (text, 0.0, float(y), 10.0, y + 5.0, kind, 16.0 if heading else 10.0, heading)


def built(spark, blocks, text=""):
    df = spark.createDataFrame([("p1", "k", 1, text, blocks)], PAGES)
    return [r.block for r in S.content_blocks(df).orderBy("block_no").collect()]


def test_table_and_figure(spark):
    lines = ["Part      Stock   Shelf", "Hinge     140     B", "Bracket   9       C", "Latch     31      A"]
    out = built(spark, [block(x, y=i) for i, x in enumerate(lines)] + [block("Plate 7", "image")])
    assert [b.type for b in out] == ["table", "figure"]
    assert out[0].headers == lines[0].split() and out[0].rows == [x.split() for x in lines[1:]]
    assert out[0].source_block_count == 4 and out[0].bbox == [0.0, 0.0, 10.0, 8.0]


def test_rows_are_padded_and_text_alone_is_a_paragraph(spark):
    assert built(spark, [block("a  b"), block("c  d  e")])[0].headers == ["a", "b", ""]
    assert [(b.type, b.text) for b in built(spark, None, "  only text ")] == [("paragraph", "only text")]
    assert built(spark, [], " ") == []


def automaton(kinds):
    """Left to right: tables of two lines or more first, then lists that take in list-like lines."""
    out, i = [], 0
    while i < len(kinds):
        j = i
        while j < len(kinds) and kinds[j] in "tb":
            j += 1
        if j - i >= 2:
            out.append(("table", j - i))
            i = j
        elif kinds[i] in "lb":
            j = i + 1
            while j < len(kinds) and kinds[j] in "lb":
                j += 1
            out.append(("list", j - i))
            i = j
        else:
            out.append(("paragraph", 1))
            i += 1
    return out


def test_runs_equal_the_automaton(spark):
    line = {"t": "a  b", "l": "- x", "b": "- x  y", "p": "plain"}
    cases = ["".join(c) for n in range(1, 6) for c in itertools.product("tlbp", repeat=n)]
    df = spark.createDataFrame([(c, "k", 1, "", [block(line[k]) for k in c]) for c in cases], PAGES)
    got: dict = {}
    for r in S.content_blocks(df).orderBy("page_id", "block_no").collect():
        got.setdefault(r.page_id, []).append((r.block.type, r.block.source_block_count or 1))
    assert {c: got[c] for c in cases} == {c: automaton(c) for c in cases}


def test_a_page_of_many_lines(spark):
    rows = [(f"{i}  x" + "  y" * (i % 2)) for i in range(1500)] + ["plain", "- a"] * 700
    out = built(spark, [block(x) for x in rows])
    assert [b.type for b in out] == ["table"] + ["paragraph", "list"] * 700
    assert len(out[0].rows) == 1499 and {len(r) for r in out[0].rows} == {3}


def test_sections_and_title(spark):
    rows = [("p1", "k", 1, "First line\nmore", [block("intro"), block("Title", heading=True), block("body")]), ("p2", "k", 2, "", [block("Empty", heading=True), block("Last", heading=True)])]
    pages = spark.createDataFrame(rows, PAGES)
    b = S.content_blocks(pages)
    kept = [(r.heading, r.block_count) for r in S.sections(b, "packet_id").orderBy("section_no").collect()]
    assert kept == [(None, 1), ("Title", 1), ("Last", 0)]
    assert S.titles(b, pages, "packet_id").first().title == "First line"


def document(spark, blocks, title=None, name="d"):
    made = [dict(zip(("type", "text", "page", "headers", "rows", "items", "metadata"), (*x, None))) for x in blocks]
    row = {"document_id": name, "document_type": "resume", "source": {"packet_id": "k", "page_start": 1, "page_end": 2}, "content": {"title": title, "sections": [{"heading": "H", "page": 1, "blocks": made}]}}
    return spark.createDataFrame([row], DOCUMENT)


P = lambda text: ("paragraph", text, 1, None, None, None)


def test_label_takes_in_its_list(spark):
    d = document(spark, [P("Skills:"), ("list", "", 2, None, None, ["Python", "Machine Learning"])])
    r = C.chunks(d).collect()
    assert [(x.text, x.block_type, x.page_start, x.page_end) for x in r] == [("Skills:\nPython\nMachine Learning", "merged", 1, 2)]


def test_labels_in_a_row_pair_off(spark):
    texts = lambda *b: [x.text for x in C.chunks(document(spark, list(b))).orderBy("chunk_id").collect()]
    table = ("table", "t", 1, ["h"], [["c", None]], None)
    assert texts(P("a:"), P("b:"), P("c:"), P("x")) == ["a:\nb:", "c:\nx"]
    assert texts(P("a:"), table) == ["a:", "h\nc |"]
    assert texts(P("a:"), P(" "), P("x")) == ["a:", "x"]
    assert texts(P("a:")) == ["a:"]


def test_windows_and_bare_title(spark):
    text = "".join(chr(97 + i % 26) for i in range(2500))
    w = spark.createDataFrame([(text,), ("x" * 1000,), ("",)], "t string").select(C.windows(F.col("t")).alias("w")).collect()
    want = [text[i : i + 1000] for i in (0, 900, 1800)]
    assert w[0].w == want and w[1].w == ["x" * 1000] and w[2].w == [""]
    only = C.chunks(document(spark, [], title="Just a title")).collect()
    assert [(x.chunk_id, x.text) for x in only] == [("d_chunk_001", "Just a title")]
