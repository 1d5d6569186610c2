"""Terms that give entities away, beyond the entity's own line and string."""

import math
import random
import re
import time
from collections import Counter
from itertools import product

from pyspark.sql import functions as F

from hydrospark.llm import pii


def extras(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [{s["value"] for s in r["extra"]} for r in pii.find(docs).orderBy("doc_id").collect()]


def test_terms_are_marked_on_every_line_and_in_every_document(spark):
    texts = [f"Write to zb@x.org, item {i}\nZbigniew calls back" for i in range(20)] + ["A note for Zbigniew"] + [f"write of item number {i}, note calls back for all" for i in range(200)]
    got = extras(spark, texts)
    assert all("zbigniew" in e for e in got[:21])
    assert not any(got[21:])


def test_strings_that_occur_once_are_reached_by_their_class(spark):
    texts = [f"Zbigniew uses {box}@acme.org for item {i}" for i, box in enumerate(("zb", "z.b", "zbig"))] + [f"Card {4111111111111111 + 0 * i} holder Wojtek{'!' * i}" for i in range(2)]
    texts += [f"Someone uses {'abcdefghij'[i % 10]}{i}@other{i}.org for item {i}, card holder" for i in range(10)] + [f"uses item {i} for a card holder" for i in range(300)]
    got = extras(spark, texts)
    assert all("zbigniew" in e for e in got[:3]) and all("wojtek" in e for e in got[3:5])
    assert not any({"uses", "item", "card", "for"} & e for e in got) and not any(got[15:])


def brute_terms(texts):
    """Disclosing terms by counting all pairs of entity and term."""
    found = []
    for t in texts:
        boxes = sorted(set(re.findall(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", t)))
        of = {"is " + b for b in boxes} | {"domain " + b.split("@")[1].lower() for b in boxes} | {"mailbox " + b.split("@")[0].lower() for b in boxes} | {"kind email" for _ in boxes}
        plain = t
        for b in boxes:
            plain = plain.replace(b, " ")
        found.append((t, of, set(re.findall("[a-z]{3,}", plain.lower())), set(re.findall("[a-z]{3,}", t.lower()))))
    total, n_e, n_t, n_et, texts_of = len(texts), Counter(), Counter(), Counter(), {}
    for t, of, terms, everywhere in found:
        n_e.update(of)
        n_t.update(everywhere)
        for pair in product(of, terms if of else ()):
            n_et[pair] += 1
            texts_of.setdefault(pair, set()).add(t)
    told = set()
    for (e, t), n in n_et.items():
        content = math.log2(total / n_e[e])
        if len(texts_of[e, t]) >= pii.SUPPORT and content > 0 and n_t[t] and min(1.0, math.log2(n * total / (n_e[e] * n_t[t])) / content) >= pii.GENERALISE:
            told.add(t)
    return told


def test_terms_as_counted_by_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcd") for _ in range(4))
    people = [(f"box{i}@d{i % 9}.org", word() + "x" * (i % 5)) for i in range(40)]
    texts = []
    for _ in range(300):
        parts = [word() for _ in range(rng.randrange(3, 12))]
        for box, name in rng.sample(people, rng.choice((0, 0, 0, 1, 3))):
            parts += [box, name]
        rng.shuffle(parts)
        texts.append(" ".join(parts))
    texts += texts[:20] + [" ".join(b for b, _ in people) + " passage both texts share " + n for n in ("here", "there")]
    want = brute_terms(texts)
    got = extras(spark, texts)
    assert len(want) > 20
    monkeypatch.setattr(pii, "MOST_SENT", 3)
    assert extras(spark, texts) == got
    assert got == [{t for t in re.findall("(?<![a-z])[a-z]{3,}(?![a-z])", re.sub(r"\S+@\S+", lambda m: " " * len(m[0]), text)) if t in want} for text in texts]


def test_pairs_do_not_grow_with_what_a_text_has_alone(spark):
    long = lambda k: " ".join(f"box{k}n{i}@host{k}n{i}.org" for i in range(800)) + " " + " ".join("w" + "".join(chr(97 + int(c)) for c in str(k * 10**6 + i)) for i in range(8000))
    start = time.perf_counter()
    got = extras(spark, [long(1), long(2), "plain words alone"])
    assert time.perf_counter() - start < 60
    assert got == [set(), set(), set()]


def test_terms_outside_of_spans(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        cuts = sorted(rng.sample(range(4000), 2 * rng.choice((0, 1, 40, 700))))
        places = [(a, b, f"t{a}", a / 4000) for a, b in zip(cuts[::2], cuts[1::2])]
        base = sorted((a, a + rng.randrange(1, 30), "s") for a in (rng.randrange(4000) for _ in range(rng.choice((0, 1, 50)))))
        rows.append((i, places, base))
    span = "array<struct<start:int,end:int,value:string{}>>"
    got = spark.createDataFrame(rows, f"i int, places {span.format(',share:double')}, base {span.format('')}").select("i", pii.outside(F.col("places"), F.col("base")).alias("got")).collect()
    want = {i: [p for p in places if not any(p[0] < e and s < p[1] for s, e, _ in base)] for i, places, base in rows}
    assert {r["i"]: [tuple(s) for s in r["got"]] for r in got} == want
