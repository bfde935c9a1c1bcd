from __future__ import annotations

import random
import re
from collections import Counter

from sparkwell.llm.quality_rules import COLUMNS, line_first


def measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many = Counter(grams)
    covered = {j for i, g in enumerate(grams) if many[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_measures_are_those_of_brute_force(spark, odd_docs, no_docs):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["a", "b", "cé", "d|", "#"]) + rnd.choice(["", "\n", "  ", "\x0b", "\x1c"]) for _ in range(rnd.randint(0, 60))) for _ in range(200)]
    texts += [" ".join(f"w{i % 40}" for i in range(3000)), "x " * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in line_first(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == measures(texts[r.doc_id])
    got = line_first(odd_docs).select(COLUMNS).collect()
    assert sorted(tuple(r[1:7]) for r in got) == sorted(measures(r.text) for r in odd_docs.collect())
    assert line_first(no_docs).count() == 0


def test_lines_are_judged_first(spark):
    prose = "This is a plain sentence with quite a few words in it, and it ends well."
    more = "Another one follows here, which says something else at about the same length."
    cases = {
        1: f"{prose}\nHome | News | About | Contact\n{more}\nAll rights reserved.",
        2: "Home | News | About | Contact | Help | Login | Terms | Press\nShop | Cart | Search | Sale | New | Old | Blog | More",
        3: "WOW!! BUY!! NOW!! THE!! BEST!! OFFER!! EVER!! COME!! AND!! SEE!! IT!! TODAY!!",
        4: "th### ing*** er$$$ ou%%% and&&& st### ing*** re$$$ at%%% on&&& nd### ed***",
    }
    got = {r.doc_id: r for r in line_first(spark.createDataFrame(list(cases.items()), "doc_id long, text string")).collect()}
    assert {k: got[k].kept for k in got} == {1: True, 2: False, 3: False, 4: False}
    assert got[1].text == f"{prose}\n{more}" and got[1].n_lines_failed == 2
