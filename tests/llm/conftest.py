import pytest
import public_tokenizers


@pytest.fixture(scope="session")
def paths():
    return {n: public_tokenizers.path(f) for n, f in (("word", "word_bpe_49k.json"), ("byte", "byte_bpe_50k.json"), ("piece", "piece_bpe_32k.model"))}


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, a column that clashes with results."""
    long_text = " ".join(f"word{i % 977} and more," for i in range(20_000))
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi", "en", "s", 1.0),
        (2, None, "en", None, 2.0),
        (3, "", None, "s", None),
        (4, long_text, "en", "s", 4.0),
        (5, "  \n\t ", "de", "s", 5.0),
        (6, "ein zwei drei", "de", "s", 6.0),
        (6, "ein zwei drei", "de", "s", 6.0),
        (7, "🙂 中文 naïve <|endoftext|> x y　z 1234567 ... !!", "fr", "t", 7.0),
        (8, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi", "en", "s", 8.0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")
