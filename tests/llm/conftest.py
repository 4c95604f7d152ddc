import re

import pytest

#: Texts for the defined cases: null, empty, white space, ties, copies, a very long text.
LONG = " ".join(f"word{i % 977} und{i % 31}" for i in range(40_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Rows with nulls, repeats and long texts, and extra columns whose names clash with helper names."""
    rows = [(1, "The same text here."), (2, "The same  text\there."), (3, None), (4, ""), (5, "  \n "), (6, LONG), (7, LONG + " end"),
            (8, "a"), (8, "a"), (None, "The same text here."), (None, None), (9, "x" * 30_000), (10, "mail jo@ex.org, +1 (555) 010-9999 now"),
            (11, "Ünï 日本語 🙂 ﬁ\u0000 end"), (12, "!!! ... ???\n\n\n")]
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", i, "y", 1.5, ["z"]) for i, t in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint, _id string, _hash bigint, "
                                 "_row string, score double, bands array<string>")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def contract_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
