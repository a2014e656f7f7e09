"""The price trigger on a stream: keys of a session share their state's rows, and each goes its own way."""

import datetime as dt
import random

from marketlens.streaming import minute

T0 = dt.datetime(2024, 1, 2, 9)


def by_hand(batches):
    """Each key by itself, batch by batch; windows no later than the last one seen don't count."""
    state, out = {}, []
    for rows in batches:
        for s, u, t, close, base in sorted(rows, key=lambda r: r[2]):
            anchor, seen = state.get((s, u), (base, None))
            if not (close > 0 and base > 0) or (seen is not None and t <= seen):
                continue
            if abs(close / base - 1) <= minute.REVERT:
                if anchor != base:
                    anchor = base
                    out.append((s, u, t, close, "REVERT", anchor))
            elif abs(close / anchor - 1) >= minute.FIRE:
                anchor = close
                out.append((s, u, t, close, "FIRE", anchor))
            state[s, u] = (anchor, t)
    return out


def test_keys_share_rows_of_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(minute, "GROUPS", 2, raising=False)
    draw, batches = random.Random(4), []
    for k in range(3):
        rows = [(f"s{draw.randrange(2)}", f"u{draw.randrange(30 - 10 * (k == 1))}", T0 + dt.timedelta(minutes=10 * k + draw.randrange(14)), draw.choice([100.0, 100.5, 103.0, 104.0, 107.5, 96.0, 0.0, -1.0]), 100.0) for _ in range(300)]
        batches.append(list({r[:3]: r for r in rows}.values()))
    batches[1] = [r for r in batches[1] if r[0] == "s0"] + [("s9", "bad", T0, 5.0, 0.0)]
    schema = "session string, symbol string, ts timestamp, close double, base double"
    said = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = minute.stream_price_trigger(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        q.awaitTermination()
        said.append(max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]))
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("session", "symbol", "ts", "close", "event", "anchor").collect()]
    assert sorted(got) == sorted(by_hand(batches)) and {r[4] for r in got} == {"FIRE", "REVERT"}
    assert said[-1] <= 5  # two for each of s0 and s1, one for s9; not one for each of some sixty keys
