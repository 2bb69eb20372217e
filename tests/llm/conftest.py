import os
import random

import pytest

from presslens.llm.common import find_package

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
#: Columns whose names the operators use inside.
CLASHING = "size bigint, digest string, row bigint, text_hash bigint, score double, x_digest string, label int, part int, N_CHARS_ string"
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHING}"


@pytest.fixture(autouse=True)
def package(spark):
    find_package(spark)


def sentence(rng, words):
    return " ".join(rng.choice(VOCABULARY) for _ in range(words))


VOCABULARY = [a + b for a in ("ban", "tor", "mi", "sel", "qua", "rin") for b in ("da", "lo", "ken", "ti", "vor", "zu", "m")]


def messy_rows():
    """Nulls, empty, very long, equal and nearly equal texts, repeated rows and ids."""
    rng = random.Random(5)
    texts = [sentence(rng, rng.randint(3, 120)) for _ in range(40)]
    long_text = sentence(rng, 9000)
    near = texts[0].split() + ["one", "more", "word"]
    passage = sentence(rng, 90)
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, long_text), (104, long_text + " end"), (105, texts[3]), (106, texts[3] + "  "),
             (107, texts[3].replace(" ", "\n")), (108, " ".join(near)), (109, texts[5]), (110, texts[5]), (110, texts[5]), (110, texts[6]), (None, texts[7]), (None, texts[7]),
             (None, None), (111, "a"), (112, "A"), (113, "é ß   x   y 中文"), (114, passage + " tail one"), (115, "head " + passage), (116, passage + passage), (117, "x" * 5000)]
    return [(i, t, "en", [None, "s1", "s2", "s1"][k % 4], None if t is None else len(t), 1, "d", 2, 3, 0.5, "x", 1, 7, "n") for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
