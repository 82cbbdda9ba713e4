import pytest

from quire.sources import importer, settings


def files(spark, names, content="text\n"):
    return spark.createDataFrame([(f"/x/{n}", n, content) for n in names], "path string, file_name string, content string")


def test_numeric_order(spark):
    found = importer.discover(files(spark, ["2-b.md", "010-c.md", "020-d.md", "README.md", ".hidden.md"]))
    chapters, warnings = importer.plan_folder(found)
    assert [(r["id"], r["title"]) for r in chapters.orderBy("ordinal").collect()] == [("ch-0001", "B"), ("ch-0002", "C"), ("ch-0003", "D")] and warnings == []


@pytest.mark.parametrize("names", [["a.md", "b.md"], ["01-a.md", "1-b.md"], []])
def test_ambiguous(spark, names):
    with pytest.raises(importer.AmbiguousOrder):
        importer.plan_folder(files(spark, names))


def test_manifest(spark):
    text = 'title = "T"\n[[chapter]]\nfile = "b.md"\ntitle = "Bee"\n[[chapter]]\nfile = "a.md"\n'
    chapters, warnings = importer.plan_folder(files(spark, ["a.md", "b.md", "c.md"], "# Head\n\nx"), importer.parse_manifest(text))
    assert [r["title"] for r in chapters.orderBy("ordinal").collect()] == ["Bee", "Head"] and len(warnings) == 1
    with pytest.raises(importer.AmbiguousOrder):
        importer.plan_folder(files(spark, ["a.md"]), importer.parse_manifest(text))
    for bad in ("", '[[chapter]]\nfile = ""', '[[chapter]]\nfile = "a"\n[[chapter]]\nfile = "a"'):
        with pytest.raises(importer.AmbiguousOrder):
            importer.parse_manifest(bad)
    proposed = importer.parse_manifest(importer.proposed_manifest(files(spark, ["z.md", "10-b.md", "2-a.md"])))
    assert [f for f, _ in proposed.chapters] == ["2-a.md", "10-b.md", "z.md"]


def test_continuous(spark):
    doc = spark.createDataFrame([("d", "front\n# One\nx\n# Two\ny\n")], "id string, text string")
    marked = importer.boundaries(doc, "id", "text")
    got = importer.continuous_split(marked, "id").orderBy("chapter_no").collect()
    assert [(r["title"], r["content"], r["source_key"]) for r in got] == [("One", "# One\nx", "d#chapter-0001"), ("Two", "# Two\ny\n", "d#chapter-0002")]
    assert importer.front_matter(marked, "id").first()["has_front_matter"]
    by_regex = importer.boundaries(doc, "id", "text", regex=r"^# (O.*)$")
    assert [r["title"] for r in importer.continuous_split(by_regex, "id").collect()] == ["One"]


@pytest.mark.parametrize("text,regex,problem", [("# A\n# a", None, "duplicate title"), ("x", None, "no chapter boundary"), ("x\ny", "z*", "zero-length match")])
def test_boundary_problems(spark, text, regex, problem):
    doc = spark.createDataFrame([("d", text)], "id string, text string")
    found = importer.boundary_problems(importer.boundaries(doc, "id", "text", regex=regex), "id")
    assert problem in {r["problem"] for r in found.collect()}


def test_settings():
    s = settings.Settings(title='A "b"', scene_target=3, auto_accept=True)
    assert settings.load(settings.dump(s)) == s
    assert settings.prompt_version("<!-- prompt-version: scene-card-v3 -->") == ("scene-card", 3)
    assert settings.should_upgrade("prompt-version: a-v1", "prompt-version: a-v2") and not settings.should_upgrade("prompt-version: b-v1", "prompt-version: a-v2")
    roles = settings.Settings(models={"default": {"provider": "p", "model": "m"}, "chat": {"model": "n"}})
    assert settings.model_for(roles, "chat") == ("p", "n")


def test_manifest_is_found(tmp_path):
    assert importer.find_manifest(str(tmp_path)) is None
    (tmp_path / "book.toml").write_text("x")
    assert importer.find_manifest(str(tmp_path)).endswith("book.toml")
    (tmp_path / "toc.toml").write_text("x")
    assert importer.find_manifest(str(tmp_path)).endswith("toc.toml")
    with pytest.raises(FileNotFoundError):
        importer.find_manifest(str(tmp_path), str(tmp_path / "other.toml"))


def test_contents_are_read_back(spark):
    chapters = spark.createDataFrame([(2, "b.md", 'The "end"'), (1, "a.md", "A \\ b")], "ordinal int, file string, title string")
    got = importer.parse_manifest(importer.contents(chapters, "Book"))
    assert got.title == "Book" and got.chapters == [("a.md", "A \\ b"), ("b.md", 'The "end"')]


def test_one_document(spark):
    doc = spark.createDataFrame([("intro\n# One\ntext\n# Two\nmore",)], "text string")
    whole, none = importer.plan_file(doc, "my-book.md", single=True)
    assert [(r["id"], r["title"]) for r in whole.collect()] == [("ch-0001", "One")] and none == []
    parts, warnings = importer.plan_file(doc, "my-book.md")
    assert [(r["id"], r["title"]) for r in parts.orderBy("ordinal").collect()] == [("ch-0001", "One"), ("ch-0002", "Two")] and len(warnings) == 1
    with pytest.raises(importer.AmbiguousOrder, match="no chapter boundary"):
        importer.plan_file(doc, "x.md", level=3)
