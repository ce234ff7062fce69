"""Rows and a fixture that the tests of this folder share."""

import random

import pytest

from vsframe.llm.common import let_workers_import

WORDS = {
    "en": "the of and river stone garden window under bright morning letter paper carries slowly old house".split(),
    "de": "der die und fluss stein garten fenster unter heller morgen brief papier trägt langsam altes haus größe".split(),
    "fr": "le la et rivière pierre jardin fenêtre sous clair matin lettre papier porte lentement vieille maison où".split(),
}


@pytest.fixture(autouse=True)
def workers(spark):
    let_workers_import(spark)


def prose(rnd, lang, n):
    return " ".join(rnd.choice(WORDS[lang]) + (rnd.choice([".", ",", ""])) for _ in range(n))


def corpus(seed=1, n=60):
    """(doc_id, text, lang): prose with exact and near copies, shared lines and
    passages, nulls, empty and very long texts, repeated rows."""
    rnd = random.Random(seed)
    passage = prose(rnd, "en", 60)
    line = "All rights reserved by the old river house"
    rows = []
    for i in range(n):
        lang = rnd.choice(sorted(WORDS))
        text = prose(rnd, lang, rnd.randrange(1, 150))
        if i % 5 == 0:
            text += "\n" + rnd.choice([line, "  " + line.upper() + "\t", line + " "])
        if i % 7 == 0:
            text = prose(rnd, lang, 10) + " " + passage + " " + text
        if i % 9 == 0 and rows:
            text = rows[rnd.randrange(len(rows))][1] or ""
        if i % 11 == 0:
            words = text.split(" ")
            words[len(words) // 2] = "changed"
            rows.append((1000 + i, " ".join(words), lang))
        rows.append((i, text, lang))
    rows += [(2000, None, "en"), (2001, "", None), (2002, "\n\n \n", "fr"), (2003, prose(rnd, "de", 6000), "de")]
    rows += [(2004, "a", "en"), (2005, "É" * 450, "fr"), (2006, "🙂 !!", None), rows[3], rows[3]]
    rows += [(None, "no id but some text that is long enough to matter", "en"), (None, None, None)]
    return rows


SCHEMA = "doc_id long, text string, lang string"
#: Columns that operators use inside, as columns of the input.
CLASH = ["key", "node", "size", "h", "row", "pos", "_id", "_row", "_flags", "_lang", "_key", "spans", "score", "token_ids", "n_chars"]


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(7).cast("long") for c in CLASH})
