"""Main content of made-up sites with known lines."""

import random

from folio.llm import boilerplate as B

NOTICES = ["We use cookies to improve your visit.", "Back to top", "Accept all", "Join our newsletter today."]


def made(n=60, seed=1):
    chance, rows, truth = random.Random(seed), [], set()
    words = [f"{a}{b}" for a in ("lo", "mi", "ka", "re", "su") for b in ("ran", "tel", "vor", "dim", "pas", "gul")]
    sentence = lambda: " ".join(chance.choices(words, k=chance.randint(8, 14))).capitalize() + "."
    for k in range(n):
        host = f"{chance.choice(['velmor', 'ribelul', 'gathoos'])}{k % 3}.test"
        lines = [("Home | Shop | About us", True), ("", None), (f"# {sentence()[:-1]}", False), ("", None)]
        for _ in range(4):
            lines += [(" ".join(sentence() for _ in range(3)), False), ("", None)]
        lines.insert(6, (NOTICES[0], True))
        lines += [("```py", False), ("Back to top", False), ("```", False), ("", None), ("**Popular posts**", True), (f"- [{sentence()[:-1]}](http://{host}/{k})", True), ("", None)]
        lines += [(n, True) for n in NOTICES[1:]]
        rows.append((str(k), host, None if k % 7 else "", "\n".join(x for x, _ in lines)))
        truth |= {(str(k), no) for no, (_, site) in enumerate(lines, 1) if site}
    return rows, truth


def test_found(spark):
    rows, truth = made()
    df = spark.createDataFrame([*rows, rows[0], ("n", None, None, None), ("e", "h", "t", "")], "article_id string, host string, title string, markdown string")
    got = {(r.article_id, r.line_no) for r in B.not_article(df).collect()}
    assert len(got & truth) / len(truth) > 0.97 and len(got & truth) / len(got) > 0.97
    texts = {r.article_id: r.content for r in B.main_text(df).collect()}
    assert texts["n"] is None and texts["e"] == "" and "cookies" not in texts["1"] and "Back to top" in texts["1"]


def test_copies_are_no_notices(spark):
    rows, truth = made()
    body = "# Of lanterns\n\nA lantern hangs by the gate. Nobody lights it now.\n\nThe keeper left when the road moved away."
    notices = ["Write to us about anything you miss here.", "Our shop opens at noon on weekdays.", "All prices hold until the end of May."]
    copies = [(f"c{k}", f"{'abcdefghij'[k % 10]}mirror.test", "", f"{body}\n\n{notices[k % 3]}" if k % 4 else body) for k in range(40)]
    df = spark.createDataFrame([*rows, *copies, copies[0]], "article_id string, host string, title string, markdown string")
    got = {(r.article_id, r.line_no) for r in B.not_article(df).collect()}
    assert not {(k, no) for k, no in got if k.startswith("c") and no <= 5}
    assert len({x for x in got if x[0][0] != "c"} & truth) / len(truth) > 0.97
    assert all("lantern hangs" in r.content for r in B.main_text(df).where("article_id like 'c%'").collect())


def test_notices_of_one_host(spark, monkeypatch):
    monkeypatch.setattr(B, "RECUR_RATE", 0.1)
    rows, truth = made(90)
    notice = "Letters reach us through the side door."
    small = [(f"s{k}", "smallsite.test", "", f"{rows[k][3]}\n\n{notice}") for k in range(6)]
    rows = [r for r in rows[6:]]
    df = spark.createDataFrame([*rows, *small], "article_id string, host string, title string, markdown string")
    got = {(r.article_id, r.line_no) for r in B.not_article(df).collect()}
    assert {(k, text.count("\n") + 1) for k, _, _, text in small} <= got
    assert all(notice not in r.content for r in B.main_text(df).where("article_id like 's%'").collect())


def test_empty(spark):
    df = spark.createDataFrame([], "article_id string, host string, title string, markdown string")
    assert B.not_article(df).count() == 0


def test_patterns_are_no_notices():
    rows = [(k, f"Why does the {w} wait?", 50) for k, w in enumerate("abcdefghij")] + [(20, "We use cookies.", 50), (21, "", 50), (22, "", 5)]
    assert B.recurring_sentences(rows, 10) == {20: "We use cookies.", 21: ""}
    assert B.recurring_sentences([], 1) == {}


def test_long_notices(spark):
    import random

    chance = random.Random(1)
    words = [f"{a}{b}" for a in ("stone", "river", "glass", "paper", "light") for b in ("work", "field", "side", "man", "ton", "ly")]
    prose = lambda: " ".join(chance.choices(words, k=30)).capitalize() + ", and so on."
    notice = "By reading on you accept that this site and all of its many partners keep small files on your machine, " + "that they may be read again whenever you come back, " * 9 + "and that you were told so."
    rows = [(str(k), f"h{k % 7}.example", "T", f"# {prose()[:40]}\n\n{prose()} {prose()}\n\n{prose()}\n\n{notice}\n\n{prose()}") for k in range(60)]
    found = {(r.article_id, r.line_no) for r in B.not_article(spark.createDataFrame(rows, "article_id string, host string, title string, markdown string")).collect()}
    assert found == {(str(k), 7) for k in range(60)}


def test_long_line():
    model = B.Model(frozenset(), frozenset(), frozenset(), 0)
    assert B.site_lines("x" * 200_000, "h", None, model) == []
    assert B.shape_of(B.lines_of("word " * 50_000)[0]).split("/")[3] == "5"
