"""Several writers and readers of one rollup, with their steps interleaved."""

import os

import pytest

from axisloom.llm import rollup


@pytest.fixture
def change(spark):
    return lambda *rows: spark.createDataFrame(list(rows), rollup.CHANGES)


def insert(k, n=10):
    return ("insert", k, "s", "en", "v1", n, None)


def delete(k, n=10):
    return ("delete", k, "s", "en", "v1", n, None)


def totals(roll):
    return [tuple(r) for r in roll.totals().collect()]


def during(monkeypatch, then, at="_commit"):
    """Runs ``then`` once, just before the next commit."""
    real = getattr(rollup.Rollup, at)

    def late(self, *a):
        monkeypatch.setattr(rollup.Rollup, at, real)
        then()
        return real(self, *a)

    monkeypatch.setattr(rollup.Rollup, at, late)


def test_a_batch_committed_while_others_are_compacted_stays(spark, tmp_path, monkeypatch, change):
    roll = rollup.Rollup(spark, str(tmp_path / "roll"))
    roll.apply("a", change(insert(1)))
    during(monkeypatch, lambda: roll.apply("b", change(insert(2, 7))))
    assert roll.compact()
    assert roll.batches() == ["a", "b"] and roll._names("batches") == ["b"]
    assert totals(roll) == [("s", "en", "v1", 2, 17)]
    assert not roll.apply("b", change(insert(2, 7))) and not roll.apply("a", change(insert(1)))
    assert roll.compact() and totals(roll) == [("s", "en", "v1", 2, 17)] and roll.batches() == ["a", "b"]


def test_of_two_writers_that_delete_the_same_one_is_refused(spark, tmp_path, monkeypatch, change):
    roll = rollup.Rollup(spark, str(tmp_path / "roll"))
    roll.apply("a", change(insert(1), insert(2, 3)))
    during(monkeypatch, lambda: roll.apply("first", change(delete(1))))
    with pytest.raises(rollup.Refused):
        roll.apply("second", change(delete(1)))
    assert totals(roll) == [("s", "en", "v1", 1, 3)] and roll.batches() == ["a", "first"]
    # deletes of different documents both count
    roll.apply("c", change(insert(4), insert(5)))
    during(monkeypatch, lambda: roll.apply("d", change(delete(4))))
    assert roll.apply("e", change(delete(5))) and totals(roll) == [("s", "en", "v1", 1, 3)]


def test_one_id_sent_by_two_writers_counts_once(spark, tmp_path, monkeypatch, change):
    roll = rollup.Rollup(spark, str(tmp_path / "roll"))
    answers = []
    during(monkeypatch, lambda: answers.append(roll.apply("a", change(insert(1)))))
    assert not roll.apply("a", change(insert(1))) and answers == [True]
    assert totals(roll) == [("s", "en", "v1", 1, 10)]
    assert len(os.listdir(tmp_path / "roll/data")) == 1 and not os.listdir(tmp_path / "roll/unfinished")


def test_of_two_compactions_one_counts(spark, tmp_path, monkeypatch, change):
    roll = rollup.Rollup(spark, str(tmp_path / "roll"))
    roll.apply("a", change(insert(1)))
    answers = []
    during(monkeypatch, lambda: answers.append(roll.compact()))
    assert not roll.compact() and answers == [True]
    assert totals(roll) == [("s", "en", "v1", 1, 10)] and roll.batches() == ["a"]


def test_a_rename_into_a_folder_is_taken_back(spark, tmp_path, monkeypatch, change):
    """Both writers see no entry; the store moves the second one's folder into the first one's."""
    roll = rollup.Rollup(spark, str(tmp_path / "roll"))
    roll.apply("a", change(insert(1)))
    number, entry = roll._now()

    class Blind:
        def __init__(self, fs):
            self.fs, self.once = fs, True

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def exists(self, path):
            if self.once:
                self.once = False
                return False
            return self.fs.exists(path)

    monkeypatch.setattr(roll, "fs", Blind(roll.fs))
    assert not roll._commit(number, {"base": None, "batches": []})
    assert roll._now() == (number, entry) and totals(roll) == [("s", "en", "v1", 1, 10)]


def test_totals_are_read_across_compaction_until_cleaned(spark, tmp_path, change):
    roll = rollup.Rollup(spark, str(tmp_path / "roll"))
    roll.apply("a", change(insert(1)))
    roll.apply("b", change(insert(2)))
    before = roll.totals()
    assert roll.compact()
    roll.apply("c", change(insert(3)))
    assert [tuple(r) for r in before.collect()] == [("s", "en", "v1", 2, 20)]
    roll.clean()
    assert [tuple(r) for r in before.collect()] == [("s", "en", "v1", 2, 20)]
    half = tmp_path / "roll/data/never-committed"
    half.mkdir()
    roll.clean(keep_seconds=-1)
    assert len(os.listdir(tmp_path / "roll/data")) == 2 and len(os.listdir(tmp_path / "roll/log")) == 1
    assert totals(roll) == [("s", "en", "v1", 3, 30)] and roll.batches() == ["a", "b", "c"]
    assert not roll.apply("a", change(insert(1))) and roll.apply("d", change(delete(1))) and totals(roll) == [("s", "en", "v1", 2, 20)]


def test_long_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "s", "en", "a b " * 50_000, 1, "x"), (2, None, None, None, 2, "y")], "doc_id long, source string, lang string, text string, bucket int, t string")
    assert {(r.doc_id, r.n_tokens) for r in rollup.counted(docs, rollup.WORDS_V1).collect()} == {(1, 100_000), (2, 0)}
