import random

from lumenfold.llm.decontaminate import op3_decontaminate, with_leaks
from tests.llm import brute

SF = "/root/testdata/sf0.001"
Q = "If Alice buys 12 apples and then Alice gives Bob 5 kg of them , how many apples does she keep for the whole week"


def leaks(spark, texts, items, **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string").withColumnRenamed("k", "item_id")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {r.item_id: [(x.item_id, x.covered, x.consistency) for x in r.leaks] for r in with_leaks(docs, bench, **how).collect()}


def test_other_parameters_are_caught_if_consistent(spark):
    other = Q.replace("Alice", "Carla").replace("Bob", "Dan").replace("12", "40").replace("5 kg", "7 lb")
    mixed = "If Alice buys 12 apples and then Eve gives Bob 5 kg of them , how many apples does she keep for the whole week"
    got = leaks(spark, [f"some text before. {Q} and behind", other, mixed, "no question here at all , " * 10, Q[:40]], [Q])
    assert got[0][0][0] == 0 and got[1][0][1] >= 13
    assert got[0][0][2] == 1.0 and got[1][0][2] == 1.0 and got[3] == [] and got[4] == []
    assert leaks(spark, [mixed], [Q], consistency=1.0)[0] == []  # Alice stands for two names


def test_odd_rows(spark):
    texts = [None, "", " ", "a b", Q, Q, "word " * 20_000 + Q]
    got = leaks(spark, texts, [Q, None, "", "a b", "short item here", Q])
    assert [bool(got[k]) for k in range(7)] == [False, False, False, False, True, True, True]
    assert [x[0] for x in got[4]] == [0, 5]
    assert leaks(spark, ["so a short item here is"], ["short item here"])[0] == [(0, 3, 1.0)]
    assert all(x == [] for x in leaks(spark, texts, []).values())
    empty = spark.createDataFrame([], "k int, text string")
    assert with_leaks(empty, spark.createDataFrame([(1, Q)], "item_id int, text string")).collect() == []


def test_a_join_of_windows_gives_the_same(spark):
    r = random.Random(2)
    items = [" ".join(f"w{r.randrange(300)}" for _ in range(r.randint(2, 30))) for _ in range(40)] + [Q, None, "", Q, "a b", "short item here", f"{Q} and more"]
    texts = [" ".join([r.choice(items[:40]), "and so on", r.choice(items[:40])]) for _ in range(30)]
    texts += [None, "", " ", "a b", Q, Q, "word " * 20_000 + Q, "so a short item here is", Q.replace("Alice", "Mary Ann").replace("12", "40").replace("5 kg", "7lb"), " ".join(filter(None, items))]
    a = leaks(spark, texts, items)
    assert sum(map(bool, a.values())) > 30 and len(a[len(texts) - 1]) > 35
    for block in (300, 4000):
        assert leaks(spark, texts, items, block_bytes=block) == a


def test_a_join_keeps_rows_and_columns(spark):
    docs = spark.createDataFrame([(None, Q, "x", 1), (1, Q, "y", 2), (1, Q, "y", 2), (2, None, None, 3)], "doc_id int, body string, leaks string, item int")
    bench = spark.createDataFrame([(None, Q, 5), (7, Q, 6)], "doc_id int, text string, block int")
    for block in (1, 1 << 20):
        got = with_leaks(docs, bench, text="body", item="doc_id", block_bytes=block)
        assert got.columns == ["doc_id", "body", "item", "leaks"]
        assert sorted((r.item, [x.item_id for x in r.leaks]) for r in got.collect()) == [(1, [None, 7]), (2, [None, 7]), (2, [None, 7]), (3, [])]
        assert with_leaks(docs.limit(0), bench, text="body", item="doc_id", block_bytes=block).collect() == []


def test_a_join_keeps_common_templates_apart(spark):
    items = [f"What is the sum of {k} and {k + 1} if one more is taken away from {k} again" for k in range(300)]
    texts = [f"so : {x}" for x in items[:40]] + ["What is the sum of 1 and 2 if one more is taken away from 9 again"]
    a, b = leaks(spark, texts, items), leaks(spark, texts, items, block_bytes=2000)
    assert a == b and all(k in [x[0] for x in a[k]] for k in range(40))


def test_query_finds_all_and_only_whole_items(spark):
    docs = {r.doc_id: brute.words(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: brute.words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {(d, i) for d, w in docs.items() for i, q in items.items() if any(w[k : k + len(q)] == q for k in range(len(w) - len(q) + 1))}
    assert {(r.doc_id, r.item_id) for r in op3_decontaminate(spark, SF).collect()} == want and want


def test_exact_copies_of_few_literals(spark):
    items = [
        "HOW MANY STATES BORDER THE GULF OF MEXICO AND WHICH ONE HAS THE LONGEST COAST LINE",
        "How Many States Border The Gulf Of Mexico And Which One Has The Longest Coast Line",
        "Maria Lopez met Juan Perez in Buenos Aires 2019",
        "1 2 3 4 5 6 7 8 9 10",
    ]
    other = "SOME TITLE OF QUITE ANOTHER THING THAT HAS NO WORD LIKE IT AND THEN GOES ON"
    got = leaks(spark, [*(f"some text , {q} and behind" for q in items), other, items[0][:40] + " " + other], items)
    assert [{x[0] for x in got[k]} for k in range(6)] == [{0, 1}, {0, 1}, {2}, {3}, set(), set()]


def test_names_that_open_sentences(spark):
    q = "Alice has 5 apples. Alice buys 3 more apples. Alice eats 2 apples. How many apples are left?"
    other = q.replace("Alice", "Carla").replace("5", "9").replace("3", "6")
    got = leaks(spark, [other, f"so {other}", other.replace("Carla eats", "Eve eats"), other.replace("apples", "boats in the yard")], [q])
    assert [bool(got[k]) for k in range(4)] == [True, True, True, False]
    assert got[0][0][1:] == (18, 1.0)
    assert leaks(spark, [other.replace("Carla eats", "Eve eats")], [q], consistency=1.0)[0] == []


def test_parameters_of_another_length(spark):
    q = "If every baker sells ten loaves before noon then Alice gets two more loaves from them for each child"
    short = "the train from Boston to Chicago carries 5 kg of Alice 's mail"
    texts = [q.replace("Alice", "Mary Ann"), short.replace("Boston", "New York"), short.replace("5 kg", "7kg"), short.replace("Alice", "Mary Ann Lee")]
    got = leaks(spark, texts, [q, short])
    assert [[x[0] for x in got[k]] for k in range(4)] == [[0], [1], [1], [1]]
    words = q.split()
    added = [" ".join([*words[:k], "really", *words[k:]]) for k in range(1, len(words))]
    assert all(r for r in leaks(spark, added, [q]).values())
    few = "one plain item of just twelve words that says nothing much here".split()
    added = [" ".join([*few[:k], "really", *few[k:]]) for k in range(1, len(few))]
    assert all(r for r in leaks(spark, added, [" ".join(few)]).values())


def test_names_in_both_directions_and_units_of_other_languages(spark):
    one = "If Carla buys 12 apples and then Carla gives Carla 5 kg of them , how many apples does she keep for the whole week"
    q = "Un panadero vende 5 kilos de pan cada mañana y guarda 3 kilos para los niños del barrio pobre"
    got = leaks(spark, [one, q.replace("kilos", "gramos").replace("5", "8")], [Q, q], consistency=1.0)
    assert got[0] == [] and [x[0] for x in got[1]] == [1]
    assert [x[0] for x in leaks(spark, ["Ann has 4 apples and buys 7 more today"], ["Tom has 3 apples and buys 5 more today"])[0]] == [0]


def test_units_and_names_beyond_a_few_languages(spark):
    """Other units of the same kind, and capitals of other scripts; a noun that is no unit stays what it is."""
    pairs = [
        ("Tom pours 7 liters of milk and drinks 2 liters before he goes home tonight", "Tom pours 5 gallons of milk and drinks 3 gallons before he goes home tonight"),
        ("the horse ran 12 kilometers on the first day and 9 kilometers on the last", "the horse ran 5 furlongs on the first day and 4 furlongs on the last"),
        ("this morning Tom gave Ann 3 coins and then Tom took 1 coin back from her", "this morning Łukasz gave Šárka 8 coins and then Łukasz took 5 coin back from her"),
        ("вчера утром Иван купил 5 яблок и отдал Марии 2 яблока", "вчера утром Пётр купил 9 яблок и отдал Ольге 4 яблока"),
        ("σήμερα ο Νίκος αγόρασε 5 μήλα και έδωσε στην Άννα 2 από αυτά", "σήμερα ο Γιώργος αγόρασε 8 μήλα και έδωσε στην Ελένη 3 από αυτά"),
    ]
    got = leaks(spark, [f"so , {b} , and on" for _, b in pairs], [a for a, _ in pairs])
    assert [[x[0] for x in got[k]] for k in range(len(pairs))] == [[k] for k in range(len(pairs))]
    friends = [pairs[0][1].replace("gallons", "friends"), pairs[3][1].replace("Пётр купил", "дом стоит"), pairs[1][1].replace("the horse ran", "a quiet town had")]
    assert [x for k in range(3) for x in leaks(spark, friends, [a for a, _ in pairs])[k] if x[0] in (0, 3)] == []
