import zlib

from pyspark.sql import functions as F
from strandline.llm.langid import fit, identify, in_training

DATA = "/root/testdata/sf0.01/documents.parquet"
SCHEMA = "doc_id long, text string, lang string, score string"


def test_split_by_crc(spark):
    rows = spark.range(200).select("id", in_training(F.col("id")).alias("t")).collect()
    assert all(r.t == (zlib.crc32(str(r.id).encode()) % 4 != 2) for r in rows)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA)
    model = fit(docs.where(in_training(F.col("doc_id"))))
    got = identify(docs.where(~in_training(F.col("doc_id"))), model).collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert sum(r.rejected for r in got) <= 0.01 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
    again = fit(docs.repartition(5).where(in_training(F.col("doc_id"))))
    assert (again.centroids == model.centroids).all()


def test_null_ids_are_not_held_out(spark):
    assert spark.range(1).select(in_training(F.lit(None).cast("long")).alias("t")).first().t is True


def test_gibberish_and_languages_that_were_not_learnt_are_rejected(spark):
    docs = spark.read.parquet(DATA)
    model = fit(docs.where(in_training(F.col("doc_id"))))
    odd = ["zxqj vkpw qqzz xjkv wqpz kkvx jqxz pwvk " * 5, "Szczęście przychodzi wtedy, gdy człowiek potrafi cieszyć się każdą chwilą życia bez pośpiechu", "mga tao ay ipinanganak na may layang magkakapantay sa karangalan at mga karapatan"]
    got = identify(spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id int, text string"), model).collect()
    assert sum(r.rejected for r in got) >= 2
    kept = identify(docs, model)
    assert kept.where("rejected").count() <= 0.01 * docs.count()


def test_more_languages_than_the_sample_and_an_odd_label(spark):
    rows = [(i, f"word{i} and more of language {i % 30}", f"l{i % 30}") for i in range(90)]
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=10)
    assert len(set(model.langs)) == 30
    docs = spark.read.parquet(DATA).where(in_training(F.col("doc_id")))
    junk = spark.createDataFrame([(10**9, "qz", "en")], "doc_id long, text string, lang string")
    one, two = fit(docs), fit(docs.select("doc_id", "text", "lang").union(junk))
    assert abs(one.least.max() - two.least.max()) < 0.05  # one odd text moves no limit far


def test_brute_force_on_a_small_fixture(spark):
    """The prediction once more, from the formula, with plain dictionaries."""
    import math
    from collections import Counter

    from strandline.llm.langid import DIM

    rows = [(0, "ab ab cd", "x"), (1, "ab ce", "x"), (2, "zz yz", "y"), (3, "zy zz", "y"), (4, "ab zz ab", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(df, k=1)

    def grams(t):
        b = f" {t} ".encode()
        out = Counter()
        for i in range(len(b) - 1):
            if b[i : i + 2] != b"  ":
                out[((b[i] << 8 | b[i + 1]) * 2654435761 % 2**32) >> 20] += 1
        for i in range(len(b) - 2):
            if b[i + 1 : i + 3] != b"  ":
                out[((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2246822519 % 2**32) >> 20] += 1
        return out

    told = [(grams(t), lang) for _, t, lang in rows if lang]
    df_of = Counter(g for c, _ in told for g in c)
    idf = lambda g: math.log((1 + len(told)) / (1 + df_of[g])) + 1
    unit = lambda v: {g: x / math.sqrt(sum(y * y for y in v.values())) for g, x in v.items()}
    vec = lambda c: unit({g: math.log1p(n) * idf(g) for g, n in c.items()})
    centre = {}
    for lang in ("x", "y"):
        total = Counter()
        for c, own in told:
            if own == lang:
                total.update(vec(c))
        centre[lang] = unit(total)
    assert DIM == 1 << 12
    for r in identify(df, model).collect():
        v = vec(grams(r.text))
        cos = {lang: sum(x * c.get(g, 0) for g, x in v.items()) for lang, c in centre.items()}
        best = max(sorted(cos), key=cos.get)
        assert r.lang_pred == best and abs(r.score - cos[best]) < 1e-4


def test_odd_rows(spark):
    rows = [(i, t, lang, "x") for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("le chat est sur la table", "fr"), ("the dog", "en"), ("la maison", "fr")])]
    model = fit(spark.createDataFrame(rows, SCHEMA))
    odd = spark.createDataFrame([(1, None, None, "x"), (2, "", "en", "x"), (3, "12 34 ½ %", "en", "x"), (4, "the " * 100000, None, "x"), (5, "the mat", "en", "x"), (5, "the mat", "en", "x"), (6, "漢字 仮名", "ja", "x")], SCHEMA)
    got = {r.doc_id: r for r in identify(odd, model, names=("lang_pred", "cosine", "rejected")).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and all(got[i].rejected and got[i].cosine == 0 for i in (1, 2, 3))
    assert got[4].lang_pred == got[5].lang_pred == "en" and not got[5].rejected
    assert got[6].rejected and got[5].score == "x"
    assert fit(odd.limit(0)) is None
    assert identify(odd, None, names=("a", "b", "c")).where("a = 'und' and c").count() == 7
    assert identify(odd.limit(0), model, names=("a", "b", "c")).count() == 0
