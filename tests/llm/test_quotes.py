import random

from watchloom.llm import quotes as Q

SCHEMA = "conv_id long, turn long, role string, text string, thread string, parent int, root int, c0 string"


def talk(spark, given):
    return spark.createDataFrame([(*g, "role", "x", 1, 2, "y") if False else (g[0], g[1], "user", g[2], "x", 1, 2, "y") for g in given], SCHEMA)


def result(spark, given):
    return {(r["conv_id"], r["turn"]): r for r in Q.reply_order(talk(spark, given)).collect()}


def test_levels_rewrapping_and_partial_quotes(spark):
    given = [
        (1, 0, "First point here.\nSecond line\n\nAnother paragraph"),
        (1, 1, "> first POINT\n>   here. second line\nI agree"),
        (1, 2, "> > First point here.\n> > Second line\n> I agree\n\nSo do I\n> unknown words"),
        (1, 3, "no quotes"),
        (1, 4, ">Another paragraph\n>> \nyes"),
        (2, 0, "I agree"),
        (2, 1, "> Second line\nother conversation"),
    ]
    got = result(spark, given)
    reply = {k: (r["reply_to"], r["thread"], r["depth"], r["n_quotes"], r["n_linked"]) for k, r in got.items()}
    assert reply[1, 1] == (0, 0, 1, 1, 1) and reply[1, 2] == (1, 0, 2, 3, 2) and reply[1, 3] == (None, 3, 0, 0, 0)
    assert reply[1, 4] == (0, 0, 1, 1, 1) and reply[2, 1] == (None, 1, 0, 1, 0)
    assert got[1, 1]["text"] == "I agree" and got[1, 2]["text"] == "So do I" and got[1, 3]["text"] == "no quotes"


def test_trimmed_quotes(spark):
    given = [
        (1, 0, "One line here.\nA second  line\nand the third\n\nLast words of it"),
        (1, 1, "> a second line\n> and the third\n\nmine"),
        (1, 2, "> second line\n> and the\nof that"),
        (1, 3, "> and the third\n> Last words\nnot one passage"),
        (1, 4, "> Last words\n\n> of of it\nends"),
        (1, 5, "and words: a second line and the third, again"),
        (1, 6, "> One line here. A second\n\n> a second line\n\n> line and the third,\nyes"),
        (1, 6, "twice"),
        (2, 1, "> second line\n> and the\nelsewhere"),
    ]
    got = Q.reply_order(talk(spark, given)).filter("turn != 6 or text = 'yes'").collect()
    got = {(r["conv_id"], r["turn"]): (r["reply_to"], r["n_quotes"], r["n_linked"]) for r in got}
    assert got[1, 1] == (0, 1, 1) and got[1, 2] == (0, 1, 1) and got[1, 3] == (None, 1, 0) and got[1, 4] == (0, 2, 1)
    assert got[1, 6] == (5, 3, 3) and got[2, 1] == (None, 1, 0)


def test_latest_earlier_source_and_own_words_only(spark):
    given = [(1, 0, "same words"), (1, 1, "same words"), (1, 2, "> same words\nmine"), (1, 3, "> mine\n> > same words"), (1, 4, "> same words"), (1, 1, "same words")]
    got = result(spark, given)
    assert got[1, 2]["reply_to"] == 1 and got[1, 3]["reply_to"] == 2 and got[1, 3]["thread"] == 1 and got[1, 4]["reply_to"] == 1


def test_order_is_thread_then_turn(spark):
    given = [(1, 0, "a"), (1, 1, "b"), (1, 2, "> a\nc"), (1, 3, "> b\nd"), (1, 4, "> c\ne")]
    rows = Q.reply_order(talk(spark, given)).collect()
    assert [(r["thread"], r["turn"]) for r in rows] == [(0, 0), (0, 2), (0, 4), (1, 1), (1, 3)]


def test_long_chain_and_hot_conversation(spark):
    given = [(9, i, f"message number {i}" if not i else f"> message number {i - 1}\n\nmessage number {i}") for i in range(150)]
    given += [(9, 200 + i, "> message number 0\nok") for i in range(200)]
    got = result(spark, given)
    assert all(got[9, i]["depth"] == i and got[9, i]["thread"] == 0 for i in range(150))
    assert all(got[9, 200 + i]["reply_to"] == 0 for i in range(200))


def test_awkward_rows(spark):
    given = [(None, 0, "x"), (None, 1, "> x"), (1, None, "> x"), (1, 0, None), (1, 1, ""), (1, 2, ">"), (1, 3, " >  \n>>\n> \x01\x02"), (1, 4, "> a" * 20_000), (1, 4, "> a" * 20_000)]
    df = Q.reply_order(talk(spark, given))
    out = df.collect()
    assert len(out) == len(given) and all(r["n_linked"] == 0 and r["role"] == "user" and r["c0"] == "y" for r in out)
    assert [c for c in df.columns if c == "thread"] == ["thread"]
    assert sorted(r["text"] or "" for r in out)[:2] == ["", ""]
    assert Q.reply_order(talk(spark, [])).count() == 0


def test_same_as_looking_everywhere(spark):
    r = random.Random(8)
    given = []
    for c in range(6):
        said = []
        for t in range(25):
            own = " ".join(r.choice("red green blue grey".split()) for _ in range(2))
            q = r.choice(said) if said and r.random() < 0.7 else None
            given.append((c, t, (f"> {q}\n" if q else "") + own))
            said.append(own)
    got = result(spark, given)
    for c, t, text in given:
        want = None
        if text.startswith("> "):
            q = text.split("\n")[0][2:]
            want = max((u for d, u, x in given if d == c and u < t and x.split("\n")[-1] == q), default=None)
        assert got[c, t]["reply_to"] == want
