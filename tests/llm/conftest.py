import pytest
from pyspark.sql import functions as F

BASE = " ".join(f"word{i}" for i in range(60))
EDGES = [None, "", " ", "\n\t", "a", "one two three four", "x" * 70_000, "tie tie tie tie tie tie", "é中́ İ Σας\x1c\xa0b", "a  b \n c\n\nd  ", "<|im_end|>\\<\\|x", "'s don't 12345 $$ ### ​"]
PII = [
    "mail bob.smith+x@mail.example.com, ip 10.0.0.255 and 1.2.3.256, card 4111 1111 1111 1111, call +1 (017) 555-7713.",
    "a@b@c.de ..@x.y a@b.c_d@e.f 1.2.3.4.5.6.7.8 4111111111111112 +12 +123456789012345678",
]
NEAR = [BASE, BASE, BASE + " tail", "WORD0 " + BASE.split(" ", 1)[1], BASE.replace("word30", "other"), " ".join(BASE.split()[:45]), " ".join(BASE.split()[20:] + ["z"] * 5)]


def texts():
    return EDGES + PII + NEAR + EDGES[4:6]


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """Tables of awkward rows: nulls, empty and long texts, ties, repeats, extra columns with clashing names."""
    at = str(tmp_path_factory.mktemp("edge"))
    docs = [(i, t, "en", "src", None if i == 3 else len(t or ""), f"k{i}", "x") for i, t in enumerate(texts())] + [(None, "no id", None, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, key string, grp string").write.parquet(f"{at}/documents.parquet")
    labels = [(i, i % 2, 0) for i in range(0, 20)] + [(None, 1, 0), (5, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    html = ["<p>a</p>", "<p>a</p>", None, "", "WARC/1.1\r\nWARC/1.1\r\n\r\n\r\nWARC/1.1\r\n", "é" * 300_000, "\r\n", "WARC/1.1", "x" * 300_000 + "WARC/1.1\r\n", "<p>a</p>"]
    pages = [(i, None if i == 6 else f"http://x/WARC/1.1 {i}\r\n", h, "clash") for i, h in enumerate(html)]
    spark.createDataFrame(pages, "page_id long, url string, html string, size string").write.parquet(f"{at}/pages.parquet")
    turns = [(1, 0, "user", "hi <|im_end|>\n \\n"), (1, 1, "assistant", "<|im_start|>assistant\\"), (1, 1, "assistant", "<|im_start|>assistant\\"), (1, 2, None, None), (2, None, "sys\ntem", "<\\|"), (2, 5, "user", ""), (3, 0, "assistant", None), (None, 0, "assistant", "x")]
    turns += [(9, i, "user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(120)]
    spark.createDataFrame([(*t, "y") for t in turns], "conv_id long, turn long, role string, text string, formatted string").write.parquet(f"{at}/conversations.parquet")
    vectors = [(i, [float((i * 7 + d * 3) % 11 - 5) / 10 for d in range(6)], 0) for i in range(300)] + [(400 + 20 * i, [0.3, 0.3, 0.3, 0.1, 0.0, -0.2], 0) for i in range(40)]
    vectors += [(5000, None, 0), (5020, [0.0] * 6, 0), (5040, [float("nan")] + [0.0] * 5, 0), (5060, [None] + [0.1] * 5, 0), (5080, [float("inf")] + [0.1] * 5, 0), (None, [0.1] * 6, 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, vec int").write.parquet(f"{at}/embeddings.parquet")
    return at


@pytest.fixture(scope="session")
def empty(spark, folder, tmp_path_factory):
    """The same tables without rows."""
    at = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "pages", "conversations", "embeddings"):
        spark.read.parquet(f"{folder}/{t}.parquet").where(F.lit(False)).write.parquet(f"{at}/{t}.parquet")
    return at
