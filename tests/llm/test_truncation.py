from __future__ import annotations

import json
import random

import pytest

from lodestream.llm import truncation as t

NOTE = json.dumps({"a": [1, {"b": 'say "hi" {'}], "c": "x.\\"})


@pytest.mark.parametrize(
    "text, left_open",
    [
        (NOTE, None), ("[" + NOTE + "]", None), ("[]", None), ('```\nfn a() {\n}\n```', None), ("function f() {\n  g(\"}\");\n}", None), ("It is (so) done.", None), ('He said: "no."', None),
        ("```\nfn a() {", "fence"), ("fn a() {\n  b();", "brace"), ("see (the", "bracket"), ('He said: "no.', "quote"), ("go to <a href=", "tag"), ("a < b", None),
        # Opened a line earlier, or closed by another kind.
        ("(see the\nother", "bracket"), ('He said: "it was\nnot', "quote"), ("A (list] of things", "bracket"), ("[a (b] c", None), ('A 5" screen.', None), ('He said "no 12".', None),
        ('{"a": [1, 2}', "json"), ("so sad :( but whole", None), ("«oui\n\nnon", None), ("fn a(b[1) {}", None), ("„ja“ und “no”", None), ("[" * 200_000 + "]" * 200_000, None),
    ],
)
def test_open_structures(text, left_open):
    assert t.open_structure(text) == left_open


def test_every_cut_of_a_json_text_is_open():
    assert all(t.open_structure(NOTE[:n]) == "json" for n in range(2, len(NOTE)))


@pytest.mark.parametrize(
    "text, verdict",
    [
        ("All is done.", "whole"), ("Is it?", "whole"), ('He said "no."', "whole"), ("", "whole"), ("   ", "whole"), ("x {}", "whole"), ("Est-il là ?", "whole"),
        ("It was do", "tail"), ("It was done,", "tail"), ("It goes on...", "tail"), ("One. Tw…", "tail"), ("It was (more)", "cut"), ("It was done [...]", "cut"),
        ("It was d�", "cut"), ('{"a": "b', "cut"), ('{"a": "\\u00e', "cut"), ("He wrote \\u12", "cut"), ("It was &am", "cut"),
    ],
)
def test_endings(text, verdict):
    assert t.ending(text)[0] == verdict


def judge(spark, rows):
    df = spark.createDataFrame([(i, s, x, "v", 1) for i, (s, x) in enumerate(rows)], "doc_id long, source string, text string, verdict string, n int")
    return t.judged(df)


def test_cut_texts_are_told_from_titles_and_sign_offs(spark):
    pick = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta", "zeta", "iota"]
    sentence = lambda: " ".join(pick.choice(words) for _ in range(12)).capitalize() + "."
    rows, cut = [], set()
    for i in range(900):
        body = f"Report {i}\n\n" * (i % 3 == 0) + " ".join(sentence() for _ in range(5))
        kind = i % 9
        if kind < 3:
            n = pick.randint(40, len(body) - 2)
            while body[n - 1] in ".\n " or body[:n].endswith(("Report", str(i))) or n < 60:
                n += 1
            body, _ = body[:n], cut.add(i)
        elif kind == 3:
            body += f"\n-- desk {i}"
        elif kind == 4:
            body = f"Report {i}"
        elif kind == 5:
            body += " Let us wait and see..."
        rows.append(("s", body))
    got = {r.doc_id for r in judge(spark, rows).where("truncated").collect()}
    assert got == cut


def test_copies_of_a_cut_text_are_no_baseline(spark):
    pick = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta", "zeta", "iota"]
    sentence = lambda: " ".join(pick.choice(words) for _ in range(12)).capitalize()
    copied = "Of the copied\n\n" + sentence() + ". Much is left of the copied"
    rows = [("s", copied)] * 300 + [("s", sentence()) for _ in range(300)] + [("s", f"{sentence()}.") for _ in range(297)]
    rows += [("s", f"{sentence()}.\n-- desk {i}") for i in range(3)] + [("s", f"{sentence()}. Of the copied")]
    got = {r.doc_id for r in judge(spark, rows).where("truncated").collect()}
    # The copies neither pass the share, nor push the three sign-offs below it, nor make a title of their first line.
    assert got == {*range(600), 900}


def test_three_copies_of_a_cut_text_stay_cut(spark):
    pick = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta", "zeta", "iota"]
    sentence = lambda: " ".join(pick.choice(words) for _ in range(12)).capitalize() + "."
    rows = [("s", " ".join(sentence() for _ in range(4))) for _ in range(204)] + [("s", f"{sentence()} All of it was do")] * 3
    assert {r.doc_id for r in judge(spark, rows).where("truncated").collect()} == {204, 205, 206}


def test_texts_are_parsed_once(spark):
    verdicts = judge(spark, [("s", f"Some text {i}") for i in range(50)])
    for plan in (verdicts, verdicts.where("truncated").select("doc_id"), t.truncation_rates(verdicts)):
        plan.collect()
        final = plan._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert final.count("MapInPandas") == 1 and "ReusedExchange" in final


def test_sources_have_baselines_of_their_own(spark):
    pick = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta", "zeta", "iota"]
    sentence = lambda: " ".join(pick.choice(words) for _ in range(12)).capitalize()
    rows = [("big", sentence()) for _ in range(3000)] + [("own", sentence()) for _ in range(1000)]
    rows += [("own", f"{sentence()}. Yours, the desk") for _ in range(10)] + [("big", f"{sentence()}. See also the") for _ in range(30)]
    rows += [("own", f"{sentence()}. See also the"), ("few", f"{sentence()}. See also the"), (None, f"{sentence()}. See also the")]
    got = {r.doc_id for r in judge(spark, rows).where("truncated").collect()}
    # The desk's ten letters are usual in their source; what is usual in the large source isn't in the other of 1,000.
    assert got == {*range(4000), 4040}


def test_rates_and_limits(spark):
    rows = [("a", "x y" * 40 + "zz")] * 30 + [("a", "Done.")] * 70 + [("b", "Done.")] * 5 + [(None, "Done."), ("b", None), ("b", "")]
    got = {r.source: r for r in t.truncation_rates(judge(spark, [(s, x if x is None or len(x) < 10 else f"{i} {x[:-len(str(i))]}") for i, (s, x) in enumerate(rows)])).collect()}
    assert (got["a"].texts, got["b"].texts, got["b"].truncated, got["b"].limit_chars, got[None].share) == (100, 6, 0, None, 0.0)


def test_long_and_empty(spark):
    assert {r.truncated for r in judge(spark, [("a", "word " * 200_000 + "end."), ("a", "")]).collect()} == {False}
    assert judge(spark, []).count() == 0
