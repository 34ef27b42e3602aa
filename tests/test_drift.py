import datetime as dt

from plotweave.operators import drift

SCHEMA = "record_id long, file_id long, source string, as_of timestamp_ntz, line_no long, payload string"


def lines(spark, files):
    """Records of one source, one file for each list of payloads."""
    t = dt.datetime(2021, 1, 1)
    return spark.createDataFrame([(f * 100_000 + n, f, "s1", t + dt.timedelta(days=f), n, p) for f, ps in enumerate(files, 1) for n, p in enumerate(ps)], SCHEMA)


def test_long_chains_lead_both_ways(spark):
    name = lambda f: "owner" if f == 1 else f"k{f}"
    who, land = ["Asha", "Bimal", "Charu", "Dinesh"], ["freehold", "leasehold", "abadi", "nazul"]
    files = [[f'{{"{name(f)}": "{who[n]}", "z{f}": "{land[n]}"}}' for n in range(4)] for f in range(1, 21)]
    files.append([f'{{"k21": "{who[n]}", "tenure": "{land[n]}", "extra": "e{n}"}}' for n in range(4)])
    files.append(['{"only": "this"}', "{}", '{"cut": '])
    d = lines(spark, files)
    assert {r["column_name"] for r in drift.unmapped_columns(d).collect()} == {"extra", "only"}
    rec = {(r["file_id"], r["record_id"] % 100_000): r for r in drift.consistent_records(d).collect()}
    assert len(rec) == 21 * 4 + 2
    assert all(rec[f, n]["owner"] == who[n] for f in range(1, 22) for n in range(4))  # 20 versions back
    assert all(rec[f, 0]["other"] is None for f in range(1, 21))
    assert rec[1, 2]["tenure"] == "abadi" == rec[21, 2]["tenure"]  # 20 versions on
    assert rec[21, 3]["other"] == {"extra": "e3"} and rec[22, 0]["other"] == {"only": "this"} and rec[22, 1]["other"] is None


def test_defaults_fill_absent_keys_only(spark):
    d = lines(spark, [['{"owner": "Asha", "irrigated": null}', '{"owner": "Bimal"}', '{"owner": "Charu", "irrigated": "yes"}', "{}"]])
    rec = {r["record_id"]: r for r in drift.consistent_records(d, {"irrigated": "no", "ward": "7"}).collect()}
    assert [rec[100_000 + n]["irrigated"] for n in range(4)] == [None, False, True, False] and {r["ward"] for r in rec.values()} == {7}


def test_unknown_chain_goes_by_its_first_key(spark):
    d = lines(spark, [[f'{{"aa": "v{n}"}}' for n in range(4)], [f'{{"bb": "v{n}"}}' for n in range(4)], [f'{{"bb": "v{n}", "aa": "w{n}"}}' for n in range(4)]])
    rec = {r["record_id"]: r["other"] for r in drift.consistent_records(d).collect()}
    assert rec[100_001] == rec[200_001] == {"aa": "v1"} and rec[300_001] == {"aa": "v1", "aa@3": "w1"}


def test_small_file_beside_a_large_one(spark):
    word = lambda n: "".join(chr(97 + int(c)) for c in f"{n:06d}")
    small = [f'{{"pq": "{word(n * 997)}", "owner": "{word(900_000 + n * 997)}"}}' for n in range(36)]
    large = [f'{{"rs": "{word(n)}", "khatedar": "{word(900_000 + n)}"}}' for n in range(40_000)]
    for files in ([small, large], [large, small]):
        got = {(r["column_name"], r["change"]) for r in drift.drift_report(lines(spark, files)).collect()}
        assert got == {(c, "renamed") for c in (("rs", "khatedar") if files[0] is small else ("pq", "owner"))}
