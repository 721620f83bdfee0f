"""Term counts by cell instead of arrays of n-grams: equal models, narrow tables."""

from pyspark.sql import functions as F

from fernspan.operators import ml
from fernspan.plans import q_ml

CLASSES = ["a", "b"]


def test_models_on_cells_are_those_on_terms(spark):
    rows = [(i, f"word{i % 7} free prize {i}" if i % 3 else f"minutes of meeting {i % 5}", "a" if i % 3 else "b") for i in range(60)]
    d = ml.labelled(ml.prepared(spark.createDataFrame([*rows, (60, None, "a")], "id long, text string, y string")), CLASSES)
    c = ml.counted(d, ["words", "word_pairs", "chars"])
    assert not {"word_pairs", "chars"} & set(c.columns)
    both = lambda m, x: [tuple(r) for r in ml.scored(m, x, CLASSES).select("id", "pred", F.transform("proba", lambda p: F.round(p, 9))).orderBy("id").collect()]
    for name in ("nb_counts", "lr_word_char"):
        assert both(ml.ladder(cells=True)[name].fit(c), c) == both(ml.ladder()[name].fit(d), d)
    m = ml.ladder(cells=True)["lr_word"].fit(c)
    assert both(ml.of_terms(m, "word_pairs"), d) == both(m, c)
    assert ml.LinearText.fits(ml.of_terms(m, "word_pairs"))


def test_character_ngrams_are_not_kept_as_arrays(spark):
    """Readers hold thousands of rows at a time, and a text has thousands of n-grams."""
    d = q_ml._texts(spark, "/root/testdata/sf0.001", chars=True)
    assert not [n for n, kind in d.dtypes if kind == "array<string>"]
