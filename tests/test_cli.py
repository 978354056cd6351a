from tidewrack import cli
from tidewrack.sources import tables


def test_build_and_search(spark, tmp_path, capsys):
    rows = [("Library rules", "Rules of the library.", "", "", "http://a/1", "a", "html", "s", 0.5, 0), ("Exam", "An exam.", "", "", "http://b/2", "b", "pdf", "s", 0.5, 0)]
    tables.write_documents_jsonl(spark.createDataFrame(rows, tables.DOCUMENT), str(tmp_path / "docs"))
    cli.main(["build-index", str(tmp_path / "docs"), str(tmp_path / "ix")])
    cli.main(["search", str(tmp_path / "docs"), "library", "--index", str(tmp_path / "ix")])
    assert "http://a/1" in (out := capsys.readouterr().out) and "http://b/2" not in out
    (tmp_path / "f.txt").write_text("http://a/1\nhttp://a/login\nhttp://b/2\n")
    (tmp_path / "g.txt").write_text("http://b/2\n")
    cli.main(["dry-run", str(tmp_path / "f.txt"), str(tmp_path / "g.txt")])
    assert "http://a/1" in (out := capsys.readouterr().out) and "login" not in out and "http://b/2" not in out
    cli.main(["stats", str(tmp_path / "docs")])
    assert "n_docs" in capsys.readouterr().out


def test_demo_index_and_selfcheck(spark, tmp_path, capsys):
    cli.main(["init-demo", str(tmp_path / "demo")])
    cli.main(["build-index", str(tmp_path / "demo/documents"), str(tmp_path / "ix")])
    cli.main(["selfcheck", str(tmp_path / "demo/documents"), str(tmp_path / "ix")])
    lines = capsys.readouterr().out.strip().splitlines()
    assert sum("PASS" in x for x in lines) == 10 and not any("FAIL" in x for x in lines)
    cli.main(["search", str(tmp_path / "demo/documents"), "选课", "--index", str(tmp_path / "ix")])
    assert "courses.example.org/zh" in (out := capsys.readouterr().out) and "<mark>" in out and "library" not in out
