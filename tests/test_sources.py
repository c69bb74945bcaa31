import pytest
from pyspark.sql import functions as F

from semspace.operators.clean import find_score_columns, normalize_header, optional_column
from semspace.plans import feature_build
from semspace.sources import tables
from semspace.sources.storage import materialize, shared_dir


@pytest.fixture
def dump(tmp_path):
    """A dump as the feature build expects it, two folders down."""
    folder = tmp_path / "full" / "data"
    folder.mkdir(parents=True)
    (folder / "tropes.csv").write_text(
        ' TropeID ,Trope, Description\n'
        '007,Alpha,"two\nlines, ""quoted"""\n'
        '007,AlphaAgain,second\n'
        't2,None,lost\n'
        't3,,lost too\n'
        't4,Beta,NA\n'
        't5,Gamma,plain\n'
        't6,Delta,four to one\n')
    (folder / "film_tropes.csv").write_text("x,trope_id,y\n1,007,\n2,007,\n3,t4,\n4,,\n5,t6,\n")
    (folder / "tv_tropes.csv").write_text("trope_id\n007\n007\nt4\n" + "t6\n" * 15)
    (folder / "genderedness_filtered.csv").write_text(
        "Trope,Gender Ratio,Normalized Gender Ratio (x)\n"
        "Alpha,9,n/a\nAlpha,9,abc\nAlpha,9,0.5\nAlpha,9,0.7\nBeta,9,NaN\nGamma,1,-1e-1\n")
    return tmp_path


def test_feature_build(spark, dump, tmp_path):
    out = feature_build.build(spark, str(dump), str(tmp_path / "out" / "features.parquet"))
    rows = {r["item_id"]: r.asDict() for r in out.collect()}
    assert set(rows) == {"007", "t4", "t5", "t6"}
    alpha = rows["007"]
    assert (alpha["name"], alpha["description"]) == ("Alpha", 'two\nlines, "quoted"')
    assert (alpha["n_film"], alpha["n_tv"], alpha["n_lit"], alpha["n_total"]) == (2, 2, 0, 4)  # lit file missing
    assert alpha["dominant_media"] == "film"  # tie to the earlier medium
    assert alpha["gender_ratio"] == 0.5
    assert rows["t4"]["description"] is None and rows["t4"]["gender_ratio"] is None
    assert rows["t5"]["dominant_media"] == "unused" and rows["t5"]["frac_tv"] == 0
    assert rows["t6"]["frac_film"] == 0.062 and rows["t6"]["frac_tv"] == 0.938  # 1/16 rounds half to even


def test_first_row_comes_from_the_first_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("TropeID,Trope,Description\n1,First,x\n")
    (tmp_path / "b.csv").write_text("TropeID,Trope,Description\n1,Second,x\n" + "2,Other,long text\n" * 3000)
    got = tables.read_catalogue(spark, str(tmp_path / "*.csv")).collect()
    assert {r["item_id"]: r["name"] for r in got} == {"1": "First", "2": "Other"}


def test_locate_fails_without_catalogue(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.locate_datasets(spark, str(tmp_path), "tropes.csv")
    with pytest.raises(FileNotFoundError):
        tables.locate_datasets(spark, str(tmp_path / "absent"), "tropes.csv")


def test_missing_optional_tables_are_empty(spark, tmp_path):
    assert tables.read_occurrences(spark, str(tmp_path / "no.csv")).count() == 0
    assert tables.read_scores(spark, str(tmp_path / "no.csv")).columns == ["name", "score", "ord"]
    (tmp_path / "bare.csv").write_text("Trope,other\nA,1\n")
    assert tables.read_scores(spark, str(tmp_path / "bare.csv")).count() == 0


def test_header_discovery(spark):
    assert find_score_columns([" Trope ", "Gender Ratio", "Normalized Gender Ratio"]) == ("Trope", "Normalized Gender Ratio")
    assert find_score_columns(["Name", "gender ratio raw"]) == ("Name", "gender ratio raw")
    assert find_score_columns(["Name", "x"]) == ("Name", None)
    df = spark.createDataFrame([(1, 2)], [" TropeID ", "Other"])
    assert normalize_header(df, {"tropeid": "item_id"}).columns == ["item_id", "Other"]
    assert df.select(optional_column(df, "absent", 7).alias("x")).first()["x"] == 7


@pytest.mark.parametrize("suffix", [".parquet", ".csv", ".json", ""])
def test_read_write_by_suffix(spark, tmp_path, suffix):
    df = spark.createDataFrame([("a", "x\ny"), ("b", ' "q", ')], "k string, t string")
    path = str(tmp_path / "deep" / f"table{suffix}")
    tables.write_table(df, path)
    assert sorted(map(tuple, tables.read_table(spark, path).select("k", "t").collect())) == [("a", "x\ny"), ("b", ' "q", ')]


def test_vectors_and_manifests(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 0.0], "m", 2, None), ("b", None, "m", 2, "bad")],
                               "item_id string, v array<float>, model string, dim int, error string")
    tables.write_vectors(df, str(tmp_path / "v.parquet"))
    back = tables.read_table(spark, str(tmp_path / "v.parquet"))
    assert tables.vector_manifest(back).first().asDict() == {"n": 1, "dim": 2, "model": "m"}
    anchors = spark.createDataFrame([(1, "y", [1.0]), (0, "x", [2.0])], "anchor_idx int, name string, v array<float>")
    assert tables.anchor_manifest(anchors).first()["names"] == ["x", "y"]


def test_points_json_keeps_nesting_and_order(spark, tmp_path):
    points = spark.createDataFrame([(1, "b", [1, 2], None), (0, "a", [], 0.5)],
                                   "i int, name string, nn array<int>, g double")
    meta = spark.createDataFrame([(2, "m")], "n int, model string")
    tables.write_points_json(points, meta, str(tmp_path))
    back = tables.read_points_json(spark, str(tmp_path), points.schema).collect()
    assert [tuple(r) for r in back] == [(0, "a", [], 0.5), (1, "b", [1, 2], None)]
    assert spark.read.json(str(tmp_path / "meta")).first()["model"] == "m"


def test_materialize_uses_the_shared_folder(spark):
    df = materialize(spark.range(5).withColumn("x", F.col("id") * 2))
    assert f"{shared_dir(spark).removeprefix('file:')}/table-" in df.inputFiles()[0]
    assert df.count() == 5


def test_cluster_without_checkpoint_dir_is_refused(monkeypatch):
    class Context:
        master = "spark://host"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        shared_dir(Session())


def test_feature_build_takes_every_folder(spark, tmp_path):
    def put(folder, name, text):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(text)

    put("a", "tropes.csv", "TropeID,Trope,Description\n1,One,first\n2,Two,second\n")
    put("b", "tropes.csv", "TropeID,Trope,Description\n2,Other,later\n3,Three,third\n")
    put("a", "film_tropes.csv", "title,trope_id\nx,1\nx,2\n")
    put("b", "film_tropes.csv", "title,trope_id\ny,2\ny,3\n")
    put("b", "lit_tropes.csv", "title,trope_id\nz,3\n")
    out = feature_build.build(spark, str(tmp_path), str(tmp_path / "out" / "features.parquet"))
    got = sorted((r["item_id"], r["name"], r["n_film"], r["n_lit"]) for r in out.collect())
    assert got == [("1", "One", 1, 0), ("2", "Two", 2, 0), ("3", "Three", 1, 1)]
