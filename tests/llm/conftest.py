import pytest

SF = "/root/testdata/sf0.001"


def _rows(spark):
    """Driver documents and awkward rows; extra columns have clashing names."""
    base = [(r.doc_id, r.text, r.lang, r.source, r.n_chars)
            for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    some = base[3][1]
    odd = [(None, some, "en", None, None), (9001, None, None, "s", None), (9002, "", "en", "s", 0),
           (9003, " \n\t ", "fr", None, 4), (9004, "12 34 !!", "en", "s", 8), (9005, "word", "en", "s", 4),
           (9006, "a b c d e f " * 4000, "en", "s", 48000), (9007, some, "en", "s", len(some)),
           (9007, some, "en", "s", len(some)), (9008, some.replace(" ", "  "), "en", "s", 1),
           (None, None, None, None, None), (9009, "x" * 3000, "en", "s", 3000)]
    return [(*r, i, "t", 1.5) for i, r in enumerate(base + odd)]


@pytest.fixture(scope="session")
def table(spark, tmp_path_factory):
    """Folder with documents.parquet of several files."""
    folder = tmp_path_factory.mktemp("llm-tables")
    schema = ("doc_id long, text string, lang string, source string, n_chars long,"
              " d long, lang_pred string, score double")
    spark.createDataFrame(_rows(spark), schema).repartition(3, "d").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def docs(spark, table):
    return spark.read.parquet(f"{table}/documents.parquet")


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
