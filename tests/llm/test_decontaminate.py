import hashlib
import re

from factloom.llm.decontaminate import contamination, drop_contaminated

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(docs, items):
    wins = {}
    for k, t in items:
        w = words(t)
        for i in range(max(1, len(w) - 9)) if w else ():
            wins.setdefault(tuple(w[i : i + 10]), set()).add(k)
    out = []
    for k, t in docs:
        w, hit, ids = words(t), set(), set()
        for win, own in wins.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    ids |= own
        names = sorted(str(x) for x in ids if x is not None)
        out.append((k, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


ITEMS = [(10, "The Quick brown fox jumps over the lazy dog and then runs away quickly"), (9, "a b"), (2, "solo"), (7, None), (8, "..."), (11, "à côté de la rue où il n’y a pas de chat noir ce soir"), (10, "repeat id with ten words one two three four five six"), (None, "null id item has ten words in it right here now"), (3, "x x x x x x x x x x x x")]


def test_against_brute_force(spark):
    fox = "the quick brown fox jumps over the lazy dog and then runs away quickly"
    docs = [
        (1, f"Start {fox.upper()}, end"), (2, fox[4:60]), (3, "A, B! a-b a  b"), (4, "Solo flight"), (5, None), (6, ""), (7, " ".join(["x"] * 40)), (8, "À côté de la rue où il n’y a pas de chat noir ce soir; à côté de la rue où il n’y a pas"),
        (9, "null id item has ten words in it right here now"), (9, "clean text of no item"), (None, fox), (12, "word " * 30000 + fox), (13, f"{fox} {fox}"), (14, "quick the brown fox jumps over the lazy dog and"),
    ]
    d = spark.createDataFrame([(*x, "g", 1) for x in docs], "doc_id long, text string, gram string, n_words int")
    b = spark.createDataFrame([(*x, "w") for x in ITEMS], "item_id long, text string, window string")
    got = contamination(d, b).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(docs, ITEMS)))
    kept = drop_contaminated(d, b)
    assert kept.columns == d.columns
    assert contamination(d, b.limit(0)).where("contaminated").count() == 0 and contamination(d.limit(0), b).count() == 0


def test_joins_by_shuffle_give_the_same(spark):
    fox = "the quick brown fox jumps over the lazy dog and then runs away quickly"
    docs = [(k, f"w{k} {fox}" if k % 3 == 0 else f"clean {k}") for k in range(40)] + [(None, fox), (None, None), (3, "clean again"), (5, "A, B! a-b")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert sorted(map(str, map(tuple, contamination(d, b, broadcast_rows=0).collect()))) == sorted(map(str, brute(docs, ITEMS)))


def test_a_clean_row_does_not_go_with_its_namesake(spark):
    fox = "the quick brown fox jumps over the lazy dog and then runs away quickly"
    rows = [(None, fox), (None, "clean without an id"), (9, fox), (9, "clean with the same id")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.text for r in drop_contaminated(d, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()} == {rows[1][1], rows[3][1]}
