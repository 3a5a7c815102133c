import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot string, epoch string, content string, row string, path string"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in any column, empty and long texts, repeated rows, and columns with clashing names."""
    # n_chars and the last columns hold what no operator may rely on.
    texts = [None, "", " \n\t ", "one", "two words", "the same words again " * 10, "the same words again " * 10,
             "mail a.b@c.example.com or +1 (017) 555-7713, 10.0.0.1 and 4111 1111 1111 1111", "x" * 50_000,
             "many words here " * 20_000, "üñí ça 日本語 \U0001f600 text", "idiot trash moron", "<|endoftext|> ends here"]
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 2}" if i % 4 else None, None, "s", "t", "e", "c", "r", "p") for i, t in enumerate(texts)]
    rows += [rows[5], rows[3], (None, "no id here", "de", "src1", 3, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")
