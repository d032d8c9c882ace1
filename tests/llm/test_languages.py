"""Languages in any number and of any rarity."""

from pyspark.sql import functions as F

from keepsake.llm import languages


def test_more_languages_than_a_byte_can_number(spark):
    letters = "abcdefghijklmnopqrst"
    names = [f"l{k:03d}" for k in range(140)]
    word = lambda k: letters[k // 20] * 2 + letters[k % 20] * 3
    rows = [(k, f"{word(k)} {word(k)} {word(k)[::-1]}", name) for k, name in enumerate(names)]
    frame = spark.createDataFrame(rows, "object_id long, result_text string, language string")
    model = languages.learn_languages(frame)
    assert model.languages == tuple(names)
    found = {r.object_id: r for r in languages.identify_languages(frame, model).collect()}
    assert [found[k].language for k in range(140)] == names
    both = spark.createDataFrame([(1, " ".join([word(130)] * 9 + [word(3)] * 9))], "object_id long, result_text string")
    assert [s.language for s in languages.identify_languages(both, model).first().spans] == ["l130", "l003"]


def test_rare_language_is_learned_at_any_size(spark):
    text = F.when(F.col("id") % 40_000 == 7, "zzz qqq zzq qzz").otherwise("the and of this")
    frame = spark.range(400_000).select(F.col("id").alias("object_id"), text.alias("result_text"), F.when(F.col("id") % 40_000 == 7, "zz").otherwise("en").alias("language"))
    model = languages.learn_languages(frame)
    assert model.languages == ("en", "zz")
    few = frame.filter("object_id < 10")
    assert {r.object_id: r.language for r in languages.identify_languages(few, model).collect()} == {k: "zz" if k == 7 else "en" for k in range(10)}
