import random

import zstandard
from pyspark.sql import functions as F

from evidmill.llm.language_id import LEVEL, Classifier, Model, fit, identify, letters

STEMS = {"aa": "kan tor lem vis dro", "bb": "shu qui zee pho wex", "cc": "ñor éla üti çom ødi"}


def text(rng, lang, n):
    stems = STEMS[lang].split()
    return " ".join(rng.choice(stems) + rng.choice(stems) for _ in range(n)) + ". 12 %%"


def rows(n, seed=1):
    rng = random.Random(seed)
    return [(i, text(rng, lang := rng.choice(sorted(STEMS)), rng.choice([4, 20, 200])), lang) for i in range(n)]


def test_held_out_accuracy(spark):
    model = fit(spark.createDataFrame(rows(400), "doc_id long, text string, lang string"))
    assert sorted(model.dictionaries) == sorted(STEMS)
    out = identify(spark.createDataFrame(rows(300, 2), "doc_id long, text string, lang string"), model).where("language.lang_pred = lang")
    assert out.count() >= 295


def test_smallest_size_decides():
    rng = random.Random(3)
    model = Model({lang: letters(" ".join(text(rng, lang, 50) for _ in range(9))) for lang in STEMS})
    ready = Classifier(model)
    for lang in STEMS:
        data = text(rng, lang, 30)
        sizes = {}
        for name, content in model.dictionaries.items():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes[name] = len(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(letters(data)))
        pred, score, margin, rejected = ready.classify(data)
        assert pred == min(sizes, key=sizes.get) == lang and 0 < score <= 1 and not rejected
        assert margin == sorted(sizes.values())[1] - min(sizes.values())


def test_nulls_ties_long_texts_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", "x"), (3, "123 %% \n", "x"), (4, "kantor " * 50000, "y"), (None, "torlem", "z"), (4, "kantor", "y")],
                                 "doc_id long, text string, language string")
    model = fit(spark.createDataFrame(rows(60) + [(99, None, "aa"), (98, "x", None)], "doc_id long, text string, lang string"))
    out = identify(docs, model)
    got = out.select("doc_id", "language.*").collect()
    assert out.columns == docs.columns and len(got) == 6
    assert [r.lang_pred for r in got if r.doc_id in (1, 2, 3)] == ["und"] * 3 and all(r.score == 0 and r.rejected for r in got if r.doc_id in (1, 2, 3))
    assert {r.lang_pred for r in got if r.doc_id in (4, None)} == {"aa"}


def test_number_signs_are_no_letters():
    ready = Classifier(Model({"aa": letters("kantor lemvis"), "bb": letters("shuqui zeepho")}))
    assert ready.classify("\u00b2 \u2153 12")[0] == "und" and ready.classify("x\u00b2")[0] != "und"


def test_same_dictionaries_are_rejected():
    same = letters("kantor lemvis droshu " * 3)
    assert Classifier(Model({"aa": same, "bb": same})).classify("kantor lemvis")[3]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = fit(empty)
    assert model.dictionaries == {} and identify(empty, model).count() == 0
    one = identify(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), model).select(F.col("language.lang_pred")).first()
    assert one[0] == "und"
