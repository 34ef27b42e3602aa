import datetime as dt
import random

import numpy as np
import pytest

from plotweave.common import GEOM
from plotweave.llm import abuse, groups, leakage, resolution, survivors, tokens

G = GEOM.simpleString()
MATCH = "match_id long, src_fid string, tgt_fids array<string>, relation string, comp string"


def test_groups_against_union_find(spark):
    rng = random.Random(1)
    pairs = [(f"A{rng.randrange(300):08d}", f"A{rng.randrange(300):08d}") for _ in range(220)] + [(f"C{i:08d}", f"C{i + 1:08d}") for i in range(40)] + [("H00000000", f"H{i:08d}") for i in range(1, 200)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    rows = [(i, a.lower() if i % 3 else a + " ", [b, None], "one_to_one", "x") for i, (a, b) in enumerate(pairs)] + [(900, "Z00000001", None, "unmatched", "x"), (901, "Z00000002", [], None, "x"), (902, "Z00000003", ["Z00000001"], " Spurious", "x"), (903, None, ["Y00000001"], "split", "x"), (904, "Z00000004", ["Z00000004"], "one_to_one", "x")]
    got = {r["fid"]: r["group_fid"] for r in groups.match_groups(spark.createDataFrame(rows, MATCH)).collect()}
    want = {x: find(x) for x in list(root)} | {z: z for z in ("Z00000001", "Z00000002", "Z00000003", "Z00000004", "Y00000001")}
    assert got == want
    assert groups.match_groups(spark.createDataFrame([], MATCH)).count() == 0


SOURCES = [("cors_net", "x", 0.04, 2025, None), ("tax_roll", "x", 2.8, 2020, ["land_use"]), ("house_list", "x", 12.0, 2011, ["land_use"]), ("sat", "x", 1.4, 2022, [])]
CLAIM = "claim_id long, fid string, field string, value string, source_id string, confidence double, claimed_at timestamp_ntz, v string"


def test_survivors(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [
        (1, "P00000001", "land_use", "mixed", "CORS NET", None, t, "c"), (2, "p00000001", "land_use", "commercial", "house-list", None, t, "c"), (3, "P00000001 ", "land_use", "residential", "Tax Roll", None, t, "c"),
        (4, "P00000001", "land_use", "n/a", "tax_roll", None, t + dt.timedelta(9), "c"), (5, "P00000001", "area", "12", "sat", None, t, "c"), (6, "P00000001", "area", "13", "cors_net", None, t, "c"),
        (7, "P00000001", "area", "14", "cors_net", None, t + dt.timedelta(1), "c"), (7, "P00000001", "area", "14", "cors_net", None, t + dt.timedelta(1), "c"), (8, "P00000001", "owner", "Ravi", "walk_in", None, t, "c"),
        (9, "P00000002", "owner", None, "sat", None, t, "c"), (10, "P00000002", "owner", " -- ", "sat", None, t, "c"), (11, None, "owner", "Ravi", "sat", None, t, "c"),
    ]
    d, s = spark.createDataFrame(rows, CLAIM), spark.createDataFrame(SOURCES, "source_id string, label string, accuracy_m double, vintage long, authority array<string>")
    got = {(r["fid"], r["field"]): r["claim_id"] for r in survivors.surviving_claims(d, s).collect()}
    assert got == {("P00000001", "land_use"): 3, ("P00000001", "area"): 7}
    assert survivors.surviving_records(d, s).head()["area"] == "14"
    assert survivors.surviving_claims(d.limit(0), s).count() == 0


def test_currency_without_times(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(i * 2 + k, f"P{i:08d}", "land_use", v, "tax_roll", None, t + dt.timedelta(k), "c") for i in range(5) for k, v in enumerate(("farm", "plot"))]
    rows += [(100, "P00000100", "land_use", "plot", "tax_roll", None, None, "c"), (101, "P00000100", "land_use", "farm", "tax_roll", None, None, "c")]
    d, s = spark.createDataFrame(rows, CLAIM), spark.createDataFrame(SOURCES, "source_id string, label string, accuracy_m double, vintage long, authority array<string>")
    got = {r["fid"]: r["claim_id"] for r in survivors.surviving_claims(d, s).collect()}
    assert got["P00000100"] == 100 and got["P00000003"] == 7


def test_partial_orders(spark):
    """Chains with gaps, cycles, and untimed values among timed ones."""
    t = dt.datetime(2024, 1, 1)
    seen = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "z"), ("z", "x"), ("z", "w"), ("e", "f"), ("f", "g"), ("e", "g")] * 3
    rows = [(1000 + 10 * i + k, f"P1{i:07d}", "tenure", v, "sat", t + dt.timedelta(k)) for i, p in enumerate(seen) for k, v in enumerate(p)]
    groups_ = {
        "P00000001": ([("a", None), ("d", None)], "d"),  # b and c are not there
        "P00000002": ([("d", None), ("b", None), ("a", None)], "d"),
        "P00000003": ([("d", None), ("x", None), ("y", None)], None),  # nothing orders the cycle and d
        "P00000004": ([("w", None), ("y", None), ("x", None)], "w"),  # the cycle comes before w
        "P00000005": ([("a", 5), ("c", None)], "c"),  # an untimed value after a timed one
        "P00000006": ([("c", 1), ("d", 0), ("a", None)], "c"),  # own times go before what was learned
        "P00000007": ([("e", 2), ("g", 1), ("f", None)], "e"),  # f between contradicts the times: tied, so the latest time
        "P00000008": ([("q", None), ("p", 3)], "p"),  # nothing known
    }
    k = 0
    for f, (vals, _) in groups_.items():
        for v, at in vals:
            k += 1
            rows.append((k, f, "tenure", v, "sat", None if at is None else t + dt.timedelta(at)))
    d = spark.createDataFrame(rows, "claim_id long, fid string, field string, value string, source_id string, claimed_at timestamp_ntz")
    s = spark.createDataFrame(SOURCES, "source_id string, label string, accuracy_m double, vintage long, authority array<string>")
    got = {r["fid"]: r["value"] for r in survivors.surviving_claims(d, s).collect()}
    assert all(got[f] == want for f, (_, want) in groups_.items() if want), got
    assert all(got[f"P1{i:07d}"] == p[1] for i, p in enumerate(seen))


def test_tokens(spark):
    pytest.importorskip("tiktoken")
    texts = ["", None, "hello  world\n\n x", "<|endoftext|> नमस्ते 👩‍🌾", "a" * 3000, "word " * 40_000, " \t " * 900 + "x", "​ é"]
    d = spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_corpus(d).collect()}
    enc = tokens.encoding()
    assert all(got[i] == (enc.encode_ordinary(t) if t else []) for i, t in enumerate(texts))
    back = {r["doc_id"]: r["text"] for r in tokens.decode_corpus(tokens.encode_corpus(d)).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    assert tokens.encode_corpus(d.limit(0)).count() == 0


def test_leaks(spark):
    words = [f"w{i}x" for i in range(400)]
    rng = random.Random(3)
    items = [(i, "Pick the one right answer below now. " + " ".join(rng.sample(words, 30)), "en", "s") for i in range(6)]
    body = lambda i: items[i][1].split(". ")[1].split()
    changed = body(2)[4:22]
    changed[5] = "other"
    changed.insert(9, "indeed")
    docs = [
        (1, "noise here. " + " ".join(body(0)).upper() + " more"), (2, "<p>" + ",\n".join(body(1)[3:16]) + "</p>"), (3, "> " + " ".join(changed)), (4, "He wrote " + " ".join(body(3)[:6]) + " and no more"),
        (5, " ".join(sorted(body(4)))), (6, items[5][1].split(". ")[0]), (7, None), (8, ""), (9, "nothing " * 5000),
    ]
    d = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, pos int")
    it = spark.createDataFrame(items + items[:1], "item_id long, text string, lang string, suite string")
    assert {tuple(r) for r in leakage.leaked(d, it).collect()} == {(0, 1), (1, 2), (2, 3)}
    assert leakage.leaked(d.limit(0), it).count() == 0 and leakage.leaked(d, it.limit(0)).count() == 0


def test_align():
    assert leakage.align(np.array([1, 2, 3, 4]), np.array([9, 1, 2, 9, 3, 4])) == (4, 4, 3)
    assert leakage.align(np.array([1]), np.array([2]))[2] == 0


CHARS = abuse.CharModel.of_words({w: 50.0 for w in ["moron", "swine", "idiot", "kill", "road", "plot", "tax", "line", "stone", "map", "shithead", "you", "are", "an", "कमीना", "खेत", "सड़क"]})


def test_restore():
    cases = {
        "m0r0n": "moron", "$w1n3": "swine", "iiidiiiooot": "idiot", "i d i o t": "idiot", "s.h.i.t.h.e.a.d": "shithead", "id​iot": "idiot", "idiоt": "idiot", "W05": "w05", "plot 12/4": "plot 12/4",
        "m-0-r-0-n": "moron", "i.d-i o.t": "idiot", "$ w 1 n 3": "swine", "m_o_r_o_n!": "moron!", "s.h-1.t h e a d": "shithead", "m*r*n": "moron", "m * r * n": "moron", "k i l l  m o r o n": "kill moron", "5.7 m": "5.7 m", "1.5 2.5 m": "1.5 2.5 m",
        "क मी ना": "कमीना", "कककमीना": "कमीना", "क-मी-ना": "कमीना", "": "",
    }
    for w, want in cases.items():
        assert abuse.restore(w, CHARS) == want, w
    assert abuse.sentences("") == [] and len(abuse.sentences("a " * 500)) > 10
    assert abuse.restore("you are an i d i o t", CHARS) == "you are an idiot"


def test_abuse_learns(spark):
    rng = random.Random(0)
    good = ["the clerk measured the plot again", "the map shows a line of stone", "the tax was paid on time", "the road runs past the plot"]
    bad = ["you filthy moron get out of here", "shut up you idiot swine"]
    rows = [(i, ". ".join(rng.choices(good, k=4) + ([rng.choice(bad)] if i % 4 == 0 else [])), "en", f"s{i % 2}") for i in range(240)] + [(900, None, "en", "s0"), (901, "", "en", None), (902, "you filthy m0r0n get out of here", "en", "s1"), (903, "the clerk measured " * 9000, "en", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(3, 1), (5, None), (None, 1)], "doc_id long, toxic long")
    s = abuse.train(docs, labels)
    got = {r["doc_id"]: r["abusive"] for r in abuse.score_documents(docs, s).collect()}
    assert all(got[i] == (i % 4 == 0) for i in range(240)) and got[902] and not got[900] and not got[901] and not got[903]
    assert abuse.source_rates(abuse.score_documents(docs, s)).count() == 3
    none = abuse.train(docs, labels.limit(0))
    assert not any(r["abusive"] for r in abuse.score_documents(docs, none).collect())


def box(x, y, w, h):
    p = lambda a, b: {"x": float(a), "y": float(b)}
    return {"kind": "Polygon", "parts": [[[p(x, y), p(x + w, y), p(x + w, y + h), p(x, y + h)]]]}


def test_same_land(spark):
    names = ["Asha Verma", "Bimal Gupta", "Charu Singh", "Dinesh Yadav", "Esha Tiwari", "Farid Ansari", "Gita Mishra", "Harish Kumar"]
    parcels = [(f"P{i:08d}", f"{100 + i // 10}/{i % 10 + 1}", f"{names[i % 8]} s/o {names[(i * 3) % 8]}", box(250000 + (i % 10) * 12, 2300000 + (i // 10) * 15, 12, 15), f"W{i // 50:02d}", f"44{250006 + (i % 10) * 12:06d}{300007 + (i // 10) * 15:06d}", "n") for i in range(100)]
    legacy = []
    want = set()
    for i, (f, k, o, g, w, u, _) in enumerate(parcels):
        r = g["parts"][0][0]
        moved = box(r[0]["x"] + 3, r[0]["y"] - 2, 12, 15)
        if i == 7:
            legacy += [("L90000001", moved, k, o, 0.1, w, u, None), ("L90000002", moved, k, "Someone Else", 0.1, w, None, None)]
            want |= {("L90000001", f), ("L90000002", f)}
        elif i == 21:
            legacy += [("L90000003", box(r[0]["x"] + 3, r[0]["y"] - 2, 6, 15), k, o, 0.1, w, None, None), ("L90000004", box(r[0]["x"] + 9, r[0]["y"] - 2, 6, 15), k, o, 0.1, w, None, None)]
            want |= {("L90000003", f), ("L90000004", f)}
        elif i == 40:
            legacy.append(("L90000005", None, k, o, 0.1, w, u, None))
            want.add(("L90000005", f))
        elif i == 41:
            continue
        else:
            legacy.append((f"L{i:08d}", moved, k if i % 9 else None, o if i % 7 else "Nobody Known", 0.1, w, u, None))
            want.add((f"L{i:08d}", f))
    legacy += [legacy[0], ("L90000009", box(260000, 2310000, 9, 9), "999/9", "Nobody", 0.1, None, None, None), ("L90000010", None, None, None, None, None, None, None)]
    ls = f"fid string, geom {G}, KHSRA_NUM string, KHATEDAR_NM string, AREA_BIGHA double, WARD string, PARCEL_UID string, x string"
    ps = f"fid string, khasra_no string, owner_name string, geom {G}, ward_no string, ulpin string, name string"
    a, b = spark.createDataFrame(legacy, ls), spark.createDataFrame(parcels, ps)
    got = {(r["legacy_fid"], r["parcel_fid"]) for r in resolution.same_land(a, b).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 3
    assert {("L90000001", "P00000007"), ("L90000002", "P00000007"), ("L90000003", "P00000021"), ("L90000004", "P00000021"), ("L90000005", "P00000040")} <= got
    assert resolution.same_land(a.limit(0), b).count() == 0
