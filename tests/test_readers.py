"""Readers on small files."""

from __future__ import annotations

from shelfmark.sources import readers as R


def test_sections_of_a_folder(spark, tmp_path):
    (tmp_path / "a.html").write_text(
        "<html><title>T</title><body><nav><p>menu</p></nav><p>first</p><h2>Two</h2><ul><li><p>x</p></li></ul><script>no</script><table><tr><td>1</td><td>2</td></tr></table></body>"
    )
    (tmp_path / "b.txt").write_text("one\n\n\ntwo\n \nthree")
    (tmp_path / "c.xml").write_text("<r xmlns='u'><a>1<b>2</b></a><c/></r>")
    (tmp_path / "d.json").write_text('[{"k": 1, "n": {"z": null}}, 5]')
    (tmp_path / "e.jsonl").write_text('{"k": true}\n{"k": "v"}\n')
    (tmp_path / "f.json").write_text("{broken")
    (tmp_path / "g.doc").write_text("old")
    (tmp_path / "h.bin").write_text("x")
    (tmp_path / "i.html").write_text("")
    found = {(r.path[-6:], r.section_index): (r.heading, r.text) for r in R.sections(spark, str(tmp_path)).collect()}
    assert found["a.html", 1] == ("T", "first") and found["a.html", 2] == ("Two", "x\nx\n1 2")
    assert [found["/b.txt", k][1] for k in range(3)] == ["one", "two", "three"]
    assert found["/c.xml", 0] == ("a", "1\n2") and ("/c.xml", 1) not in found
    texts = {v[1] for v in found.values()}
    assert {'k: 1\nn: {"z": null}', "5", "k: True", "k: v"} <= texts
    outcomes = {r.extension: r.outcome for r in R.files(spark, str(tmp_path)).collect()}
    assert outcomes["doc"] == "legacy" and outcomes["bin"] == "unsupported"
    assert {r.outcome for r in R.files(spark, str(tmp_path), 2).where("extension = 'txt'").collect()} == {"too_large"}


def test_outcomes_and_routes(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("\ufeffq,a\n\"x, \"\"y\"\"\",1\n,\nz,\n".encode())
    (tmp_path / "b.csv").write_text("other\n5\n")
    (tmp_path / "c.md").write_text("intro\n# One\ntext ＡＢ\n# Two\nmore")
    (tmp_path / "d.json").write_text("{broken")
    (tmp_path / "e.xml").write_text("<!DOCTYPE r [<!ENTITY x 'y'>]><r><a>kept</a><b>cut")
    (tmp_path / "f.xml").write_text("nothing")
    (tmp_path / "g.txt").write_bytes(b"%PDF-1.7 binary")
    (tmp_path / "h.html").write_text("<html>only <b>loose</b> text</html>")
    (tmp_path / "i.txt").write_text(" \n ")
    found = {(r.path[-5:], r.section_index): r.text for r in R.sections(spark, str(tmp_path)).collect()}
    assert (found["a.csv", 2], found["a.csv", 4], found["b.csv", 2]) == ('q: x, "y"\na: 1', "q: z", "other: 5") and ("a.csv", 3) not in found
    assert found["/c.md", 1] == "# One\ntext AB" and found["e.xml", 0] == "kept"
    assert [v for (p, _), v in found.items() if p == ".html"] == ["only loose text"]
    told = {r.path[-5:]: r.outcome for r in R.outcomes(spark, str(tmp_path)).collect()}
    assert (told[".json"], told["f.xml"], told["g.txt"], told["i.txt"], told["a.csv"]) == ("malformed", "malformed", "mismatched", "empty", "ok")
