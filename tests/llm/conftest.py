import random

import pytest


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls in every column, empty and long texts, ties, repeated rows and clashing columns."""
    random.seed(5)
    words = "the of and to in that is was for on with as at by from über größe año été naïve it's don't 12,5 #x 日本 😀".split()
    prose = lambda n: " ".join(random.choice(words) + random.choice(["", "", ".", ","]) for _ in range(n))
    texts = [prose(random.randint(0, 60)) for _ in range(60)]
    texts += [texts[0], texts[0] + " ", "\t" + texts[0].replace(" ", "\n"), None, "", " \r\n\t\x0b\x0c ", None, "a", "A", "x" * 5000, prose(30_000), "<|endoftext|> it's\x01 \x85 \xa0  two  spaces", "\n\n\n"]
    rows = [(k, t, "en" if k % 3 else None, f"s{k % 2}", len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], rows[60], (None, "no id", "de", None, None), (None, None, None, None, None), (7, "another text of seven", "fr", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    extra = {c: F_lit(c) for c in ("score", "lang_pred", "fp", "key", "bucket", "length", "prefix", "row", "n", "id", "t", "shard", "kind", "__id")}
    return df.withColumns(extra)


def F_lit(c):
    from pyspark.sql import functions as F

    return F.lit(c)


@pytest.fixture(scope="session")
def none(messy):
    return messy.limit(0)
