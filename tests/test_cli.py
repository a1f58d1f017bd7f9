"""The two jobs end to end on files."""

from folioscope import cli


def test_jobs(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")
    root.mkdir()
    (root / "teacher a.pdf").write_bytes("Open the menu. Choose a class.\fMore text here.".encode())
    (root / "bad.pdf").write_bytes(b"\xff\xff")
    assert cli.health(spark, out)["status"] == "unavailable"
    dry = cli.main(["ingest", "--root", str(root), "--out", out, "--dry-run", "--preview", str(tmp_path / "p")], spark)
    assert dry == {"files": 2, "chunks": 2, "failed_chunks": 0, "failed_files": 1} and cli.health(spark, out)["status"] == "unavailable"
    cli.main(["ingest", "--root", str(root), "--out", out, "--failed-log", str(tmp_path / "log")], spark)
    assert cli.health(spark, out) == {"status": "ok", "chunks": 2}
    assert spark.read.text(str(tmp_path / "log")).first()[0].startswith("bad.pdf\t")
    assert cli.main(["embed", "--tables", out, "--dry-run"], spark)["succeeded"] == 2
    assert cli.main(["embed", "--tables", out, "--dimensions", "8", "--limit", "1"], spark) == {"succeeded": 1, "failed": 0, "dimensions": 8}
    assert cli.main(["embed", "--tables", out], spark)["succeeded"] == 1
    assert cli.main(["embed", "--tables", out], spark)["succeeded"] == 0
    assert cli.main(["embed", "--tables", out, "--all"], spark)["succeeded"] == 2
    assert spark.read.parquet(f"{out}/document_embeddings.parquet").count() == 2
