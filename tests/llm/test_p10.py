import random

import numpy as np

from larkspur.llm import p10_quality as P

SENTENCES = ["The branch manager signs the form before the end of the month.", "If the balance is low, the desk writes to the customer within ten days.", "A copy of the report stays at the office for three years.", "Staff should review the file and then release the amount.", "Where the note is missing, the team asks for a new one."]


def documents():
    rnd = random.Random(3)
    docs = [(i, " ".join(rnd.choices(SENTENCES, k=rnd.randint(4, 12)))) for i in range(150)]
    docs.append((1000, "\n".join(f"- item number {i} of desk" for i in range(20))))
    docs.append((1001, "Code\tTown\tAmt\n" + "\n".join(f"KV-{i}\tMirzan\t{i * 7}" for i in range(20))))
    docs.append((1002, "".join(rnd.choices("0123456789abcdef", k=600))))
    docs.append((1003, "~~~~ #### ==== !!!! " * 30))
    docs.append((1004, " ".join(rnd.choices(SENTENCES, k=6)) + "\n\n- first entry of it\n- second entry of it\n\n" + " ".join(rnd.choices(SENTENCES, k=6))))
    return docs


def test_kinds_nulls_repeats_and_clashes(spark, rows):
    data = [(*d, "x") for d in documents()] + [(2000, None, "x"), (2001, " \n", "x"), (None, "text", "x"), (1000, documents()[150][1], "x")]
    found = rows(P.not_prose(spark.createDataFrame(data, "doc_id long, text string, kind string")))
    assert found == sorted([(1000, "list"), (1001, "table"), (1002, "junk"), (1003, "junk"), (2000, "junk"), (2001, "junk")], key=repr)


def test_contributions_sum_to_the_distance(spark):
    q = P.quality(spark.createDataFrame(documents(), "doc_id long, text string")).toPandas()
    parts = q[[f"{s}_part" for s in P.STATISTICS]].sum(axis=1)
    assert np.allclose(parts, q["distance"], rtol=1e-6, atol=1e-6) and len(q) == 155


def test_statistics_of_a_small_text():
    code, x, counts = P.statistics("One two.\nThree, four!")
    v = dict(zip(P.STATISTICS, x))
    assert counts == [4, 2, 2] and v["mean_word_length"] == 15 / 4 and v["line_end_share"] == 1 and v["symbol_ratio"] == 0


def test_empty_table_and_long_text(spark):
    assert P.quality(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert P.statistics("word " * 300_000)[2][0] == 300_000
