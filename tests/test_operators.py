"""Retrieval, history, ingest, sources, sinks and streams on small rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from folioscope.functions.vector import cosine_to, usable_vector
from folioscope.operators import chunking, embedding, history, ingest, retrieval
from folioscope.schema import TABLES, migrated, validated
from folioscope.session import cut, estimated_bytes, maybe_broadcast
from folioscope.sources import files, sinks
from folioscope.streaming.incremental import ingest_stream


def chunk(i, title, index, vec, kind="teacher", content="text"):
    return (i, content, vec, title, f"https://x/{i}", kind, index, 1, 3, None)


def chunks(spark, rows):
    return spark.createDataFrame(rows, TABLES["chunks"])


def test_search_expands_and_bypasses(spark):
    rows = [chunk("a0", "A", 0, [0.0, 1.0], "student"), chunk("a1", "A", 1, [1.0, 0.0]), chunk("a2", "A", 2, None, ""), chunk("b9", "B", 9, [0.9, 0.1]), chunk("n", "A", None, [1.0, 0.0]), chunk("z", "Z", 0, [0.0, 0.0]), chunk("nan", "Z", 5, [float("nan"), 1.0]), chunk("d", "Z", 7, [1.0])]
    c = chunks(spark, rows)
    got = {r.id: r.similarity for r in retrieval.search(c, [1.0, 0.0], 0.5, 8, "teacher").collect()}
    assert set(got) == {"a0", "a1", "a2", "b9"}  # the null index is matched, then lost
    assert got["a0"] == 0 and got["a2"] == 0 and got["a1"] == 1
    # similarity exactly at the threshold is out
    assert retrieval.top_k(c, [1.0, 0.0], 1.0, 8).count() == 0
    assert usable_vector(c, "id", "embedding", 2) == [0.0, 1.0]
    assert cosine_to(c.limit(0), "id", "embedding", [1.0, 0.0]).count() == 0


def test_rerank_and_expand(spark):
    rows = [chunk(f"a{i}", "Gradebook", i, None, content="reading list") for i in range(12)] + [chunk("x0", "Other", 0, None, content="gradebook"), chunk("y0", None, 0, None), chunk("w0", "Zebra", 0, None, content="nothing")]
    c = chunks(spark, rows).withColumn("similarity", F.lit(0.3))
    r = retrieval.rerank(c, "gradebook", ["chunk_index", "id"])
    assert [(x.id, x.score, x["rank"]) for x in r.orderBy("rank").collect()] == [("a0", 100.0, 0), ("x0", 10.0, 1), ("y0", 0.0, 2), ("w0", 0.0, 3)]
    e = retrieval.expand(r, c).orderBy("title_rank", "chunk_index").collect()
    assert [x.id for x in e if x.title_rank == 0] == [f"a{i}" for i in range(10)]
    assert e[0].similarity == 0.3 and e[1].similarity is None
    assert next(x for x in e if x.id == "y0").title_rank == 9999


def test_candidates_gate(spark):
    rows = [chunk(f"t{i:02}", "alpha guide", i, None) for i in range(20)] + [chunk("c1", "Q", 0, None, content="beta alpha")]
    c = chunks(spark, rows)
    assert retrieval.candidates(c, "alpha").count() == 16
    got = {(r.phase, r.id) for r in retrieval.candidates(c, "beta").collect()}
    assert got == {(1, "c1")}
    assert retrieval.fallback(c, "of it").count() == 0
    assert retrieval.retrieve(c, "beta", None).count() == 1


def test_sources(spark):
    rows = [("1", "T", "http://a", "", 1, 0.1234), ("2", "T", "https://a", "x", 2, 0.9), ("3", None, "www.b", None, None, 6.0), ("4", "T", "", "x", 1, 0.5), ("5", "M", "https://m", "x", 0, -0.1), ("6", "N", "https://n", "x", 1, None)]
    d = spark.createDataFrame(rows, "id string, document_title string, source_url string, manual_type string, page_number int, similarity double")
    got = {r.url: (r.title, r.type, r.page, r.similarity) for r in retrieval.format_sources(d, ["id"]).collect()}
    assert got == {"https://a": ("T", "Unknown", 1, 12.3), "https://www.b": ("Unknown", "Unknown", None, 100.0), "https://m": ("M", "x", 0, -2.0), "https://n": ("N", "x", 1, 0.0)}
    lines = {r.url: r.line for r in retrieval.sources_markdown(retrieval.format_sources(d, ["id"])).collect()}
    assert lines["https://a"] == "- [T](https://a) (page 1)" and lines["https://m"] == "- [M](https://m)"


def brute_chunks(text, size, overlap):
    import re

    out, cur, n = [], [], 0
    for s in [x for x in re.split(r"(?<=[.?!])\s+", text) if x]:
        k = len(s.split())
        if n + k > size:
            if cur:
                out.append(" ".join(cur))
            cur, n = [], 0
            if out and len(out[-1].split()) > overlap:
                cur, n = [" ".join(out[-1].split()[-overlap:])], overlap
        cur.append(s)
        n += k
    if cur:
        out.append(" ".join(cur))
    return out


def test_chunking(spark):
    rnd = random.Random(5)
    for _ in range(200):
        t = " ".join(("w" * rnd.randint(1, 5) + rnd.choice(["", "", "", ".", "?", "! "])) for _ in range(rnd.randint(0, 120)))
        assert [c for c, _ in chunking.chunk_page(t, 20, 5)] == brute_chunks(t, 20, 5)
    assert chunking.chunk_page("") == []
    assert chunking.chunk_page("# Intro\nOne. two.", 100, 5)[0][1] == "Intro"
    pages = spark.createDataFrame([("d", 1, "a b c. d e f."), ("d", 2, "g h."), ("e", None, None)], "document_title string, page_number int, text string")
    got = [(r.document_title, r.chunk_index, r.chunk_total, r.content) for r in chunking.numbered(chunking.chunk_pages(pages, 3, 1)).orderBy("document_title", "chunk_index").collect()]
    assert got == [("d", 0, 3, "a b c."), ("d", 1, 3, "c. d e f."), ("d", 2, 3, "g h.")]
    many = spark.createDataFrame([("big" if i % 2 else f"s{i % 7}", i // 3, "a b c. d e f.") for i in range(200)], pages.schema).distinct()
    made = chunking.chunk_pages(many, 3, 1).cache()
    pick = lambda d: sorted((r.document_title, r.chunk_total, r.chunk_index) for r in d.collect())
    assert pick(chunking.numbered(made)) == pick(chunking.numbered(made, True, 20))


def test_headers_and_pages(spark):
    pages = spark.createDataFrame([("d", i, f"HEAD \nbody {i}\n{i}\nfoot") for i in range(1, 4)] + [("s", 1, "HEAD"), ("s", 2, "HEAD")], "document_title string, page_number int, text string")
    assert {tuple(r) for r in ingest.header_lines(pages).collect()} == {("d", "HEAD"), ("d", "foot")}
    assert {r.text for r in ingest.cleaned_pages(pages).filter("document_title = 'd'").collect()} == {f"body {i}" for i in range(1, 4)}
    # distinct raw lines: "A" and "A " of one page count twice
    p = spark.createDataFrame([("d", 1, "A\nA "), ("d", 2, "x"), ("d", 3, "y")], "document_title string, page_number int, text string")
    assert [r.line for r in ingest.header_lines(p).collect()] == ["A"]


def test_embedding(spark):
    class Failing(embedding.HashEmbedder):  # local, so that workers get it by value
        def __call__(self, texts):
            if any("bad" in t for t in texts):
                raise ValueError("no")
            return embedding.HashEmbedder.__call__(self, texts)

    df = spark.createDataFrame([("1", "good words"), ("2", "bad one"), ("3", None), ("4", "good words")], "id string, content string")
    got = {r.id: r for r in embedding.embed(df, "content", Failing(8), retry=embedding.Retry(pause=0.01), batch=1).collect()}
    assert got["1"].status == "success" and got["2"].status == "failed" and "no" in got["2"].error and got["3"].status == "failed"
    dry = embedding.embed(df, "content", Failing(8), dry_run=True).collect()
    assert all(r.embedding == [0.0] * 8 and r.status == "dry_run" for r in dry)
    both = {r.id: r.embedding for r in embedding.embed_distinct(df.filter("id in ('1', '4')"), "content", Failing(8)).collect()}
    assert both["1"] == both["4"]
    old = spark.createDataFrame([("a", "1", "m", [1.0]), ("b", "1", "m", [2.0]), ("c", None, "m", None)], TABLES["document_embeddings"])
    new = spark.createDataFrame([("n", "1", "m", [9.0])], TABLES["document_embeddings"])
    assert {r.id for r in embedding.upserted(old, new).collect()} == {"n", "c"}
    assert {r.id for r in embedding.upserted(old, new.limit(0)).collect()} == {"b", "c"}
    assert {r.id for r in embedding.pending(df, old, "m").collect()} == {"2", "3", "4"}
    assert {r.id for r in embedding.pending(df, old, "m", 2).collect()} == {"2"}


def test_ingest(spark):
    pages = spark.createDataFrame([("teacher a.pdf", 1, "One two. https://k.notion.site/x"), ("teacher a.pdf", 2, "Three."), ("b.pdf", 1, "For the student.")], "document_title string, page_number int, text string")
    rows = {(r.document_title, r.chunk_index): r for r in ingest.ingest(pages, embedding.HashEmbedder(8)).collect()}
    assert rows["teacher a.pdf", 0].manual_type == "teacher" and rows["b.pdf", 0].manual_type == "student"
    assert rows["teacher a.pdf", 1].source_url == "https://k.notion.site/x" and rows["teacher a.pdf", 0].chunk_total == 2
    assert all(len(r.embedding) == 8 for r in rows.values())


def test_history(spark):
    s = spark.createDataFrame([("s1", "d1", "New Chat", None, None), ("s2", "d1", "Kept", None, None)], TABLES["chat_sessions"])
    h = [("m1", "s1", "d1", "x" * 60, "a", '[{"title":"t","url":"u","type":"k","page":1,"similarity":1.5}]', None, None), ("m1", "s1", "d1", "x" * 60, "a", "[]", None, None), ("m2", "s2", "d2", "q", "a", "broken", None, None)]
    m = spark.createDataFrame(h, TABLES["chat_history"])
    assert {r.id: r.message_count for r in history.message_counts(m, s).collect()} == {"s1": 1, "s2": 1}
    assert [r.id for r in history.owned(m, s).collect()] == ["m1"]
    assert {r.id: len(r.sources) for r in history.session_history(m.filter("sources != '[]'")).collect()} == {"m1": 1, "m2": 0}
    assert {r.id: r.title for r in history.saved(s, m).collect()} == {"s1": "x" * 50 + "...", "s2": "Kept"}
    opened = history.create_or_get(s, spark.createDataFrame([("d1", "s1"), ("d9", "s1"), ("d1", None)], "device_id string, session_id string"))
    assert sorted(r.created for r in opened.collect()) == [False, True, True]
    assert {r.title for r in history.new_sessions(opened).collect()} == {"New Chat"}
    cites = spark.createDataFrame([("m", "t", "u", "k", 1, 2.0)], "message_id string, title string, url string, type string, page int, similarity double")
    assert json.loads(history.to_json(cites).first().sources) == [{"title": "t", "url": "u", "type": "k", "page": 1, "similarity": 2.0}]
    assert set(history.empty_tables(spark)) == set(TABLES)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "b.PDF").write_bytes("p1\fp2".encode())
    (tmp_path / "in" / "sub" / "a.pdf").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "in" / "c.txt").write_bytes(b"x")
    found = files.discover(spark, str(tmp_path / "in"))
    assert found.count() == 2 and files.discover(spark, str(tmp_path / "in"), limit=1).count() == 1
    good, failed = sinks.split_failed(files.extract_pages(found))
    assert [(r.page_number, r.text) for r in good.orderBy("page_number").collect()] == [(1, "p1"), (2, "p2")]
    assert [r.document_title for r in failed.collect()] == ["a.pdf"]
    blank = spark.createDataFrame([("x/e.pdf", bytearray(b" \fz"))], "path string, content binary")
    assert [(r.text, r.ocr) for r in files.extract_pages(blank, ocr=lambda c, i: f"ocr{i}").orderBy("page_number").collect()] == [("ocr1", True), ("z", False)]
    r = spark.createDataFrame([('{"data":[{"embedding":[1,2]},{"embedding":[3]}]}', '{"data":[{"id":"x/Embed-1"},{"id":"chat"}]}')], "e string, m string")
    assert [x.embedding for x in files.embedding_response(r, "e").collect()] == [[1.0, 2.0], [3.0]]
    assert [x.id for x in files.embedding_models(r, "m").collect()] == ["x/Embed-1"]
    assert files.Config.from_env({"CONTEXT_LIMIT": "5", "EMBEDDING_MODEL": "m"}).context_limit == 5
    c = chunks(spark, [chunk("1", "T", 0, [1.0])])
    sinks.append(c.drop("source_url", "id"), str(tmp_path / "out"), "chunks")
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 1 and back.first().id and back.first().created_at
    sinks.preview(c, str(tmp_path / "preview"))
    assert spark.read.text(str(tmp_path / "preview")).count() == 3
    rows = spark.createDataFrame([(['{"content":"c","embedding":[1,2],"document_title":"t"}', '{"content":"d","embedding":"[3]"}'],)], "j array<string>")
    assert {(x.content, tuple(x.embedding)) for x in sinks.from_json_rows(rows, "j").collect()} == {("c", (1.0, 2.0)), ("d", (3.0,))}
    assert migrated(c.select("id"), "chunks").columns == TABLES["chunks"].names
    ok, not_ok = validated(c, "id", "created_at")
    assert ok.count() == 0 and not_ok.count() == 1


def test_broadcast_is_checked(spark):
    small = spark.range(10)
    assert estimated_bytes(small) < 1000
    assert "Broadcast" in maybe_broadcast(small)._jdf.queryExecution().toString() or maybe_broadcast(small) is not small
    assert maybe_broadcast(small, 1) is small
    assert cut(small).count() == 10


def test_stream(spark, tmp_path):
    pages = spark.createDataFrame([("a.pdf", 1, "One. Two."), ("b.pdf", 1, "Three.")], "document_title string, page_number int, text string")
    pages.coalesce(1).write.parquet(str(tmp_path / "pages"))
    q = ingest_stream(spark, str(tmp_path / "pages"), str(tmp_path / "out"), str(tmp_path / "cp"), embedding.HashEmbedder(8))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    q = ingest_stream(spark, str(tmp_path / "pages"), str(tmp_path / "out"), str(tmp_path / "cp"), embedding.HashEmbedder(8))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2  # nothing twice


def test_hash_sample(spark):
    from folioscope.session import hash_sample

    df = spark.range(20_000).withColumnRenamed("id", "k")
    a = [r.k for r in hash_sample(df, "k", 100, 20_000).collect()]
    b = [r.k for r in hash_sample(df.repartition(7), "k", 100, 20_000).collect()]
    assert a == b and len(a) == 100 and len(set(a)) == 100
    assert hash_sample(df.limit(5), "k", 100, 5).count() == 5
    assert hash_sample(df.limit(0), "k", 100, 0).count() == 0


def _pdf(pages, compressed=True):
    import zlib

    def stream(body):
        data = zlib.compress(body) if compressed else body
        return b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(data), b" /Filter /FlateDecode" if compressed else b"", data)

    n = len(pages)
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count %d /Kids [%s] >>" % (n, b" ".join(b"%d 0 R" % (3 + 2 * i) for i in range(n)))]
    for i, lines in enumerate(pages):
        text = b"BT /F1 12 Tf 72 700 Td " + b" ".join(b"(%s) Tj 0 -14 Td" % x.replace("(", r"\(").replace(")", r"\)").encode("cp1252") for x in lines) + b" ET"
        objects += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (4 + 2 * i), stream(text)]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, o) for k, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>\n%%EOF"


def test_pdf_pages():
    from folioscope.sources.pdf import pdf_pages

    want = [["First (page)", "Größe"], [], ["Third"]]
    for compressed in (True, False):
        assert [p.split("\n") if p else [] for p in pdf_pages(_pdf(want, compressed))] == want
    assert "a b" in pdf_pages(_pdf([["x"]], False).replace(b"(x) Tj", b"[(a) -300 (b)] TJ"))[0]
    for bad in (b"", b"text", b"%PDF-1.4\n%%EOF", _pdf([["x"]]).replace(b"/Root", b"/Encrypt 9 0 R /Root")):
        with pytest.raises(ValueError):
            pdf_pages(bad)


def test_pdf_files_are_ingested(spark, tmp_path):
    (tmp_path / "teacher").mkdir()
    (tmp_path / "teacher" / "A.PDF").write_bytes(_pdf([["Hello there.", "How are you?"], []]))
    (tmp_path / "b.pdf").write_bytes(b"plain\ftext")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4 broken")
    rows = files.extract_pages(files.discover(spark, str(tmp_path))).orderBy("document_title", "page_number").collect()
    assert [(r.document_title, r.text, r.error) for r in rows] == [("A.PDF", "Hello there.\nHow are you?", None), ("A.PDF", "", None), ("b.pdf", "plain", None), ("b.pdf", "text", None), ("c.pdf", None, "ValueError: no pages")]
    kinds = ingest.document_types(files.extract_pages(files.discover(spark, str(tmp_path)))).collect()
    assert {r.document_title: r.manual_type for r in kinds} == {"A.PDF": "teacher", "b.pdf": "", "c.pdf": ""}
    assert files.named("os.path:join")("a", "b") == "a/b"


def test_retry_waits():
    r = embedding.Retry(pause=2.0)
    assert r.wait(ValueError()) == 2.0 and r.wait(embedding.RateLimited(7.5)) == 7.5 and r.wait(embedding.RateLimited()) == 2.0


def test_replaced_table(spark, tmp_path):
    from folioscope import cli

    path = f"{tmp_path}/t.parquet"
    for n in (1, 2):
        cli.replace(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    cli.replace(spark.read.parquet(path).union(spark.range(5)), path)  # reads what it replaces
    assert spark.read.parquet(path).count() == 7 and [x.name for x in tmp_path.iterdir()] == ["t.parquet"]
