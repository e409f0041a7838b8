import pyarrow as pa
import pyarrow.parquet as pq
import pytest

SF = "/root/testdata/sf0.001"

#: Cases that every operator must take: null and empty texts, blanks, a long text, repeats, special strings.
EDGES = [
    (900_001, None), (900_002, ""), (900_003, " \n\t "), (900_004, "One."), (900_005, "One."), (900_006, "word " * 30_000), (900_007, "a\n\nb\n a \n"),
    (900_008, "x<|endoftext|>  y  z 'll don't 日本語 ١٢ é"), (None, "no id here but some plain words to read in a line"), (900_009, "Same text twice\nwith lines"), (900_009, "Same text twice\nwith lines"),
]


@pytest.fixture(scope="session")
def rows():
    """``(doc_id, text)`` of the smallest table and the edge cases."""
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return [*zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True), *EDGES]


@pytest.fixture(scope="session")
def folder(rows, tmp_path_factory):
    """A folder of tables like the driver's, with the edge cases and columns whose names operators use themselves."""
    top = tmp_path_factory.mktemp("tables")
    n = len(rows)
    columns = {"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "lang": ["en"] * n, "source": [None] * n, "n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64())}
    columns["source"] = pa.array(columns["source"], pa.string())
    pq.write_table(pa.table(columns), top / "documents.parquet")
    for name in ("labels", "benchmark", "pages"):
        pq.write_table(pq.read_table(f"{SF}/{name}.parquet"), top / f"{name}.parquet")
    return str(top)


@pytest.fixture(scope="session")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="session")
def clashing(spark):
    """A few rows whose other columns have the names that operators add."""
    names = ["_body", "_key", "_hash", "_lines", "_gone", "hits", "items", "ids", "decoded", "score", "n_words", "n_tokens", "component_id", "label", "word"]
    return spark.createDataFrame([(i, f"some plain text number {i} here", *["x"] * len(names)) for i in range(6)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
