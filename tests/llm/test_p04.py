import functools
import random
from collections import Counter

from larkspur.llm import p04_scans as P

BODY = "the settlement team must reconcile the valuation report within the month and the branch manager signs the current account form\n" * 60


def vocabulary(spark, extra=""):
    return P.vocabulary(spark.createDataFrame([(BODY + extra,)] * 20, "text string"))


def words_of(found):
    return [{w for _, w in own} for own in found]


def test_confusions_are_cheap_edits():
    trie = P.Trie(["account", "current", "manager", "modern", "modem"])
    assert trie.within(["acc0unt", "ciirrent", "rnanager"], [P.CONFUSED] * 3) == [[(P.CONFUSED, "account")], [(P.CONFUSED, "current")], [(P.CONFUSED, "manager")]]
    assert words_of(trie.within(["modern", "zzz", ""], [P.CONFUSED, P.MOST, P.MOST])) == [{"modern", "modem"}, set(), set()]
    assert P.Trie([]).within(["a"], [20]) == [[]] and P.Trie(["", "a"]).within([""], [P.EDIT]) == [[(0, ""), (P.EDIT, "a")]]
    assert words_of(trie.within(["acount", "accouunt", "accxunt", "curent", "managre"], [2 * P.EDIT] * 5)) == [{"account"}, {"account"}, {"account"}, {"current"}, {"manager"}]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def weighted(a, b):
    """Least cost of edits and confusions that make ``a`` (seen) of ``b`` (meant), by plain recursion."""
    pairs = [tuple(x.split(" ")) for x in P.CONFUSIONS.split("|")]

    @functools.cache
    def cost(i, j):
        if i == len(a) and j == len(b):
            return 0
        ways = [999]
        if i < len(a) and j < len(b):
            ways.append(cost(i + 1, j + 1) + (0 if a[i] == b[j] else P.EDIT))
        if i < len(a):
            ways.append(cost(i + 1, j) + P.EDIT)
        if j < len(b):
            ways.append(cost(i, j + 1) + P.EDIT)
        ways += [cost(i + len(s), j + len(m)) + P.CONFUSED for s, m in pairs if a.startswith(s, i) and b.startswith(m, j)]
        return min(ways)

    return cost(0, 0)


def test_automaton_finds_every_word_within_the_cost():
    rnd = random.Random(4)
    words = sorted({"".join(rnd.choices("aeclinmru0", k=rnd.randint(1, 7))) for _ in range(400)})
    trie = P.Trie(words)
    seen = ["".join(rnd.choices("aeclinmru0", k=rnd.randint(0, 8))) for _ in range(60)]
    for most in (P.CONFUSED, P.MOST, 2 * P.EDIT):
        for s, found in zip(seen, trie.within(seen, [most] * len(seen))):
            assert dict((w, c) for c, w in found) == {w: c for w in words if (c := weighted(s, w)) <= most}
            assert {w for w in words if levenshtein(s, w) * P.EDIT <= most} <= {w for _, w in found}


PAGE = """Anvaya Exceptions 2023
The settlement team must reconcile the valua-
tion report within the month and the branch
rnanager signs the current acc0unt form with
Kestrel Valley Bank, Central Office
- 13 -

Anvaya Exceptions 2023
the settlement team. The team must recon-
cile the report on sign-
off within the month.
Kestrel Valley Bank, Central Office
- 14 -"""


def test_noise_and_repair(spark):
    v = vocabulary(spark, "the sign-off of the report is due and the sign-off of the form is due\n" * 20)
    page = P.Page(PAGE).read(v)
    assert sorted(page.noise) == sorted([(0, "header"), (1, "hyphen"), (3, "misread"), (4, "header"), (5, "page_number"), (7, "header"), (8, "hyphen"), (11, "header"), (12, "page_number")])
    assert page.repaired() == "The settlement team must reconcile the valuation report within the month and the branch manager signs the current account form with the settlement team. The team must reconcile the report on sign-off within the month."


def test_plain_text_and_numbers_in_tables_stay():
    v = P.Vocabulary({"alpha": 100}, {})
    text = "A plain line.\n\nKestrel recurring deposit\n1770\n5718\n\nAnother plain line."
    page = P.Page(text).read(v)
    assert page.noise == [] and page.repaired() == text


def test_nulls_empty_repeats_and_long(spark, rows):
    data = [("a", PAGE, 1)] * 2 + [("b", None, 1), ("c", "", 1), (None, PAGE, 1), ("d", BODY * 30, 1)]
    runs = spark.createDataFrame(data, "run_id string, text string, line_no int")
    found = rows(P.noise(runs))
    assert {r[0] for r in found} == {"a"} and ("a", 6, "page_number") in found
    assert P.noise(spark.createDataFrame([], "run_id string, text string")).count() == 0


def test_heads_of_few_texts_count_on_large_tables(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARE", 0.01)  # as on a large table: a word must be seen far more than LEAST_TEXTS times
    page = "Ledger Circular\nthe team must reconcile the\nreport within the month and\n\n"
    runs = [(f"r{n}", page * 3 + "Ledger Circular\nthe rest of it.", 1) for n in range(3)]
    runs += [("one", "the manager signs the cur-\nrent account form with the\n\nLedger Circular\n\nBranch staff keep the\nreport and the form and the\nteam.", 1), ("long", BODY * 20, 1)]
    found = P.noise(spark.createDataFrame(runs, "run_id string, text string, n int")).where("run_id = 'one' and noise = 'header'")
    assert [r.line_no for r in found.collect()] == [4]


def test_page_numbers_with_misread_digits_and_numbers_in_lines():
    v = P.Vocabulary({"team": 100}, {})
    for a, b, c in (("Page 17 of 27", "Page l8 of 27", "Page 19 of 27"), ("[39]", "[4O]", "[41]"), ("- 40 -", "- 4l -", "- 42 -"), ("p. 30", "p. 3l", "p. 32"), ("9", "lO", "11"), ("Page 9", "Page lO", "Page 11")):
        text = f"The team waits 3O days for the\n\n{a}\n\nreport of the team and then\n\n{b}\n\nthe team goes on with it\n\n{c}\n"
        page = P.Page(text).read(v)
        assert sorted(page.noise) == [(0, "misread"), (2, "page_number"), (6, "page_number"), (10, "page_number")]
        assert page.repaired() == "The team waits 30 days for the report of the team and then the team goes on with it"
    assert P.furniture(["Is", "", "some text here", "", "So"]) == {}


def test_decisions_depend_on_shares_not_on_the_size_of_the_table():
    one = {"account": 1000, "accounf": 5, "the": 5000, "long": 9, "term": 9}
    for size in (1, 1000):
        v = P.Vocabulary({w: n * size for w, n in one.items()}, {})
        text = "The accounf of the\nteam is due and the\nteam goes on.\n\nPage 1 of 2"
        assert (0, "misread") in P.Page(text).read(v).noise
        assert not v.is_cut("long", "term")
        rare = P.Vocabulary({w: n * size for w, n in (one | {"the": 500_000}).items()}, {})
        assert rare.is_cut("long", "term")


def test_the_same_texts_a_thousand_times_have_the_same_noise(spark):
    texts = [PAGE, PAGE.replace("acc0unt", "accaunt"), BODY, BODY.replace("month", "year"), "sign-off of the form\n" * 30]
    counts = Counter(w for t in texts for w, _, _ in P.tokens(t))
    pairs = Counter(p for t in texts for p in zip(t.lower().split(), t.lower().split()[1:]))
    found = [[p.noise for p in P.pages(texts, [None] * len(texts), P.Vocabulary({w: n * k for w, n in counts.items()}, {p: n * k for p, n in pairs.items()}))] for k in (1, 100, 1000)]
    assert found[0] == found[1] == found[2] and any(kind == "misread" for own in found[0] for _, kind in own)


def test_any_letter_may_be_wrong_too_many_or_too_few():
    v = P.Vocabulary({"manager": 1000, "mamager": 50, "report": 3}, {})
    assert [v.meant(w) for w in ("managyr", "manxager", "manger", "anager", "managerz")] == ["manager"] * 5
    assert min(P.Trie(["modem", "modexn"]).within(["modern"], [P.MOST])[0]) == (P.CONFUSED, "modem")
    assert v.meant("mznzger") is None and v.meant("reporx") is None
