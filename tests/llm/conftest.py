import pytest

ROWS = [
    (1, "Hello World one two\nshared line\nthird", "en"),
    (2, "  SHARED line\t\nother words here\n\n", "en"),
    (3, None, "fr"),
    (4, "", None),
    (5, "shared LINE\nshared line\nÉtude shared", "fr"),
    (None, "a null id\nshared line", "de"),
    (6, "x y z x y z x y z\n" * 12 + "tail # $ % words", "en"),
    (6, "x y z x y z x y z\n" * 12 + "tail # $ % words", "en"),
    (7, " ".join(f"w{i % 701}" for i in range(9000)) + "\nshared line", "en"),
    (8, "étude shared\n ÉTUDE shared ", "fr"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows and columns whose names the operators use themselves."""
    rows = [(i, t, g, n, n, "k", 1.5) for n, (i, t, g) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, pos int, h1 int, text_hash string, size double")


@pytest.fixture(scope="session")
def small_dir(spark, tmp_path_factory):
    """documents, labels and benchmark of the odd rows, as a folder of tables."""
    path = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (5, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, "a null id shared line of fifteen words that goes on and on until it ends"), (1, None)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string")


@pytest.fixture(scope="session")
def labelled_dir(spark, tmp_path_factory):
    """Tables with so many clean labelled documents that cutoffs beyond the base rules are certified; all other columns
    and tables that the pipeline reads are there."""
    path = tmp_path_factory.mktemp("labelled")
    rows = [(i, " ".join(f"t{i}x{j}" for j in range(60)), "en") for i in range(3000)]
    rows += [(5000 + i, " ".join(f"t{i}y{j}%%%" for j in range(60)), "en") for i in range(400)]
    rows += [(7000 + i, "\n".join([f"head{i} of this text", *["the same line"] * 9, *(f"w{i}z{j} and more of it" for j in range(20))]), "en") for i in range(300)]
    rows += [(9000 + i, " ".join(f"t{i}v{j}|" for j in range(60)), "xx") for i in range(30)] + [(None, None, None)]
    docs = spark.createDataFrame([(*r, "src", len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{path}/documents.parquet")
    docs.where("doc_id is not null").selectExpr("doc_id", "cast(doc_id < 5000 as int) as quality", "0 as toxic").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, rows[7][1]), (1, None)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)
