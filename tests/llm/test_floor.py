"""The score under which the pipeline drops a text."""

import random


def test_gibberish_goes_and_clean_text_stays(spark, tmp_path):
    import corpus_pipeline

    words = {"en": "the of and to in that with this from which have not they were house water", "de": "der die und das von zu mit sich auf nicht eine werden haus wasser auch nach", "fr": "le la les et des une que dans pour qui sur pas plus maison eau avec", "es": "el los las del que una para con por como pero sus agua casa este muy"}
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices(words[x].split(), k=rng.randint(8, 40))), x) for i in range(400) for x in [list(words)[i % 4]]]
    junk = [(1000 + i, "".join(rng.choices("bcdfghjklmpqvwxyz  ", k=120)), None) for i in range(20)]
    junk += [(1100, "Привет мир как дела сегодня вечером", None), (1101, "日本語の文章です。今日は天気がいい", None)]
    table = spark.createDataFrame([(i, t, x, "s", len(t)) for i, t, x in rows + junk], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, table, str(tmp_path)).collect()}
    assert kept == {i for i, _, _ in rows}
