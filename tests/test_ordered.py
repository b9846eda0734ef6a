"""Folds in event-time order: triggers, late rows, bounded state; tier histories by composed maps."""

import random
import threading
import time
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidelog.operators import assess
from tidelog.streaming import jobs, ordered

T0 = datetime(2026, 1, 1, tzinfo=UTC)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def files(spark, folder, batches, schema):
    """A stream of the batches, one a trigger."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def plain_tiers(desired, confirmations=2):
    effective, candidate, n, out = "c", None, 0, []
    for d in desired:
        if "sabc".index(d) <= "sabc".index(effective):
            effective, candidate, n = d, None, 0
        else:
            n = n + 1 if d == candidate else 1
            effective, candidate, n = (d, None, 0) if n >= confirmations else (effective, d, n)
        out.append(effective)
    return out, (effective, candidate, n)


def test_any_arrival_within_the_delay_gives_the_fold_in_order(spark, tmp_path):
    rng = random.Random(4)
    rows = [("v%d" % (n % 3), at(n * 7), n, rng.choice("sabc")) for n in range(90)]
    # arrives up to an hour behind
    arriving = sorted(rows, key=lambda r: (r[1] + timedelta(minutes=rng.uniform(0, 50)), r[2]))
    batches = [arriving[n : n + 15] for n in range(0, 90, 15)] + [[("end", ordered.END, 0, "c")]]
    out = jobs.drained(jobs.tiers(files(spark, str(tmp_path / "in"), batches, "bvid string, at timestamp, id long, desired string"), assess.Policy()), str(tmp_path / "out")).collect()
    assert {r.kind for r in out} == {"folded"} and len(out) == 90
    for v in ("v0", "v1", "v2"):
        got = [r.effective for r in sorted(out, key=lambda r: r.at) if r.bvid == v]
        assert got == plain_tiers([r[3] for r in rows if r[0] == v])[0]


def test_late_rows_are_counted_and_leave_the_fold(spark, tmp_path):
    names = "rpid long, bvid string, id long, captured_at timestamp, content string, like_count long, reply_count long, sort_mode string, position long"
    row = lambda rpid, n, minute, text: (rpid, "v", n, at(minute), text, 1, 0, "hot", 1)
    batches = [[row(1, 1, 0, "a"), row(1, 2, 100, "b"), row(2, 3, 100, "x")], [row(2, 4, 1000, "x")], [row(9, 12, 1000, "")], [row(1, 5, 50, "late"), row(1, 6, 60, "late too")], [row(1, 7, 1100, "b"), row(2, 8, 1001, "y")], [row(9, 9, 10**6, "end")], [row(9, 13, 10**6, "")], [row(1, 10, 80, "later")], [row(9, 11, 10**6 + 200, "end")]]
    stream = files(spark, str(tmp_path / "in"), batches, names)
    out = jobs.drained(jobs.state_changes(stream, "1 hour"), str(tmp_path / "out")).where("rpid < 9").collect()
    of = lambda rpid: sorted((r.current_id, r.event_type, r.previous_id) for r in out if r.rpid == rpid)
    assert of(1)[:2] == [(1, "first_seen", None), (2, "content_hash_changed", 1)]
    assert sorted((r.current_id, r.new_value) for r in out if r.event_type == "late") == [(5, "1"), (6, "2")]
    assert of(2) == [(3, "first_seen", None), (8, "content_hash_changed", 4)]
    # silent for more than 90 days: its state is gone, so the next row is the first again
    assert (10, "first_seen", None) in of(1)


@pytest.mark.parametrize(("confirmations", "fan", "width"), [(1, 2, 1), (2, 2, 3), (3, 64, 5), (4, 3, 1000)])
def test_composed_maps_equal_a_fold(spark, confirmations, fan, width):
    rng = random.Random(confirmations)
    rows = [(f"v{v}", n, d) for v in range(4) for n, d in enumerate(rng.choices("sabc", weights=[1, 2, 4, 6], k=60 * v))]
    table = spark.createDataFrame(rows, "bvid string, at long, desired string").repartition(3)
    got = {r.bvid: (r.effective, r.candidate, r.downgrades) for r in assess.tier_history(table, assess.Policy(confirmations=confirmations), block=F.floor(F.col("at") / width), fan=fan).collect()}
    assert got == {f"v{v}": plain_tiers([d for b, _, d in rows if b == f"v{v}"], confirmations)[1] for v in range(1, 4)}
    assert assess.tier_history(table.limit(0), assess.Policy(), block=F.col("at")).count() == 0


def test_folds_run_whatever_state_store_the_session_has(spark, tmp_path):
    other = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    rows = [("v", at(n), n, d) for n, d in enumerate("csbbaacc")]
    with jobs.settings(spark, {jobs.PROVIDER: other}):
        stream = files(spark, str(tmp_path / "in"), [rows[4:], rows[:4], [("end", ordered.END, 0, "c")]], "bvid string, at timestamp, id long, desired string")
        out = jobs.drained(jobs.tiers(stream, assess.Policy()), str(tmp_path / "out")).collect()
        assert spark.conf.get(jobs.PROVIDER) == other
    assert [r.effective for r in sorted(out, key=lambda r: r.at)] == plain_tiers("csbbaacc")[0]


def test_streams_that_start_at_once_in_one_session_keep_their_settings(spark):
    name, seen, inside = "spark.sql.shuffle.partitions", [], threading.Event()

    def first():
        with jobs.settings(spark, {name: "3"}):
            inside.set()
            time.sleep(1)
            seen.append(spark.conf.get(name))

    before, one = spark.conf.get(name), threading.Thread(target=first)
    one.start()
    inside.wait()
    with jobs.settings(spark, {name: "5"}):
        time.sleep(2)
        seen.append(spark.conf.get(name))
    one.join()
    assert seen == ["3", "5"] and spark.conf.get(name) == before


class Kept:
    """Value and list states of one key, in memory."""

    def __init__(self):
        self.value = None

    def exists(self):
        return bool(self.value)

    def get(self):
        return iter(self.value) if isinstance(self.value, list) else self.value

    def update(self, value):
        self.value = value

    put = update

    def appendList(self, rows):  # noqa: N802
        self.value = [*(self.value or []), *rows]

    def clear(self):
        self.value = None


def test_a_key_of_many_rows_is_folded_in_parts_of_bounded_size(monkeypatch):
    sizes, timers = [], []

    def fold(held, rows):
        sizes.append(len(rows))
        return (rows[-1][0],), rows

    handle = type("Handle", (), {"getValueState": lambda *_: Kept(), "getListState": lambda *_: Kept(), "registerTimer": lambda _, t: timers.append(t)})()
    at_mark = lambda ms: type("Times", (), {"getCurrentWatermarkInMs": lambda _: ms})()
    one = ordered.OrderedFold("at bigint, id bigint", "at bigint", "at bigint, id bigint", fold, None, 10**9)
    one.init(handle)
    monkeypatch.setattr(ordered, "AT_A_TIME", 10)
    # rows that repeat time and id stand at the ends of parts, too
    rows = sorted([(k * 1000, k % 3) for k in range(40)] + [(9000, 0)] * 15, key=lambda r: hash(r))
    for part in (rows[:20], rows[20:]):
        list(one.handleInputRows(("k",), iter([ordered.frame(part, "at bigint, id bigint").astype("int64")]), at_mark(0)))
    out = [tuple(r) for f in one.handleExpiredTimer(("k",), at_mark(30), None) for r in f.itertuples(index=False)]
    assert out == sorted(r for r in rows if r[0] < 30_000) and max(sizes) == 10
    assert sorted(one.pending.value) == sorted(r for r in rows if r[0] >= 30_000) and timers[-1] == 31


def test_rows_that_come_together_wait_packed_and_fold_as_the_others(monkeypatch):
    rng, lists = random.Random(12), []

    def listed(*_):
        lists.append(Kept())
        return lists[-1]

    late = lambda rows, n: [(*r[:2], f"late {k}") for k, r in enumerate(rows, n - len(rows) + 1)]
    handle = type("Handle", (), {"getValueState": lambda *_: Kept(), "getListState": listed, "registerTimer": lambda *_: None})()
    at_mark = lambda ms: type("Times", (), {"getCurrentWatermarkInMs": lambda _: ms})()
    sizes = []
    fold = lambda held, rows: sizes.append(len(rows)) or ((rows[-1][0],), rows)
    kinds = "at bigint, id bigint, word string"
    monkeypatch.setattr(ordered, "AT_A_TIME", 700)
    monkeypatch.setattr(ordered, "CHOSEN", 0, raising=False)
    monkeypatch.setattr(ordered, "APPENDED", 80_000, raising=False)
    one = ordered.OrderedFold(kinds, "at bigint", kinds, fold, late, 10**9)
    one.init(handle)
    come = lambda rows, ms: [tuple(r) for f in one.handleInputRows(("k",), iter([ordered.frame(rows[n : n + 1000], kinds).astype({"at": "int64", "id": "int64"}) for n in range(0, len(rows), 1000)]), at_mark(ms)) for r in f.itertuples(index=False)]
    expire = lambda ms: [tuple(r) for f in one.handleExpiredTimer(("k",), at_mark(ms), None) for r in f.itertuples(index=False)]
    # times and ids that repeat, at the ends of parts too, and words that are missing
    rows = [(rng.randrange(60) * 1000, rng.randrange(3) + (1 << 60), rng.choice(["a", None, "漢"])) for _ in range(5040)]
    order = lambda r: r[:2]
    assert come(rows, 0) == [] and sum(len(x.value or []) for x in lists) <= 2
    assert expire(0) == [] and expire(30) == [r for r in sorted(rows, key=order) if r[0] < 30_000]
    more = [(n * 7, n, "m") for n in range(8000)]
    behind = [r for r in more if r[0] < 29_000]
    assert sorted(come(more, 30)) == sorted((at, id_, f"late {n}") for n, (at, id_, _) in enumerate(behind, 1))
    assert sum(len(x.value or []) for x in lists) <= 4
    left = [r for r in rows if r[0] >= 30_000] + [r for r in more if r[0] >= 29_000]
    assert sorted(map(str, expire(10**6))) == sorted(map(str, left)) and max(sizes) == 700 and all(not x.value for x in lists)


def test_visibility_folds_rows_one_by_one_across_triggers():
    row = lambda n, visibility: (1, "v", n, n * 10, visibility, visibility is not None)
    rows = [row(1, "visible"), row(2, "folded"), row(3, None), row(4, None), row(5, "visible"), row(6, None)]
    want = [(1, 2, "folded", "visible", "folded"), (2, None, "disappeared", "folded", "missing"), (2, 5, "reappeared", "missing", "visible"), (2, 5, "unfolded", "folded", "visible"), (5, None, "disappeared", "visible", "missing")]
    for cut in range(len(rows) + 1):
        held, first = jobs.visibility_fold((None, None, None), rows[:cut])
        held, second = jobs.visibility_fold(held, rows[cut:])
        assert [r[2:7] for r in first + second] == want and held == (False, 5, "visible")
    assert jobs.visibility_fold((None, None, None), [row(7, None)])[1] == [(1, "v", None, None, "disappeared", "visible", "missing", 70)]
