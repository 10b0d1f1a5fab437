"""Every language of the labelled rows is learnt."""

import random

from axisloom.llm import langid


def test_every_language_is_learnt(spark):
    r = random.Random(5)
    rows = []
    for no in range(103):
        made = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(4)]
        rows += [(no * 10 + k, " ".join(r.choice(made) for _ in range(8)), f"l{no:03}") for k in range(6 if no < 100 else 4)]
    rows += [(5000 + k, "haus und wasser nacht " * 1000, "long") for k in range(6)]
    rows += [(5100, f"same key {k}", "l000") for k in range(30)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=8)
    assert model.langs == sorted({x for *_, x in rows})
    assert len(model.langs) == 104
