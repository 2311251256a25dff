"""States as a stream: order inside a batch, state across batches, late events."""

from folio.streaming import states


def run(spark, folder, df_of, name):
    schema = "page_id string, event_id long, at timestamp, status string"
    stream = df_of(spark.readStream.schema(schema).json(f"{folder}/in"))
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True).start(f"{folder}/{name}").awaitTermination()
    return spark.read.parquet(f"{folder}/{name}").collect()


def put(folder, number, rows):
    (folder / "in").mkdir(exist_ok=True)
    (folder / "in" / f"{number}.json").write_text("\n".join(f'{{"page_id": "{p}", "event_id": {e}, "at": "2024-01-{d:02} 00:00:00", "status": "{s}"}}' for p, e, d, s in rows))


def test_states_across_runs(spark, tmp_path):
    put(tmp_path, 1, [("a", 2, 2, "APPROVED"), ("a", 1, 1, "READY"), ("b", 3, 1, "READY")])
    first = {(r.page_id, r.event_id): (r.from_state, r.allowed) for r in run(spark, tmp_path, states.checked_states, "out")}
    assert first == {("a", 1): (None, True), ("a", 2): ("READY", False), ("b", 3): (None, True)}
    put(tmp_path, 2, [("a", 4, 3, "EXPORTED"), ("b", 5, 2, "READY")])
    both = {(r.page_id, r.event_id): (r.from_state, r.allowed) for r in run(spark, tmp_path, states.checked_states, "out")}
    assert both[("a", 4)] == ("APPROVED", True) and both[("b", 5)] == ("READY", True) and len(both) == 5


def test_same_as_batch(spark, data):
    from folio.plans import registry

    queries = registry.queries()
    key = lambda r: (r.from_state, r.status, r.times)
    assert sorted(map(key, queries["state_stream"](spark, data).collect())) == sorted(map(key, queries["illegal_transitions"](spark, data).collect()))


def test_daily_moves(spark, tmp_path):
    put(tmp_path, 1, [("a", 1, 1, "READY"), ("a", 2, 1, "APPROVED"), ("b", 3, 9, "READY")])
    put(tmp_path, 2, [("c", 4, 20, "READY"), ("d", 5, 21, "READY")])
    daily = lambda df: states.daily_moves(states.checked_states(df))
    run(spark, tmp_path, daily, "days")
    put(tmp_path, 3, [("e", 6, 28, "READY"), ("late", 7, 1, "READY")])
    rows = run(spark, tmp_path, daily, "days")
    got = {(r.day.start.day, r.to_state): (r.moves, r.refused) for r in rows}
    # Days that the watermark has passed are out, once each, and late events no longer change them.
    assert got[(1, "READY")] == (1, 0) and got[(1, "APPROVED")] == (1, 1) and got[(9, "READY")] == (1, 0)
    assert len(got) == len(rows)
