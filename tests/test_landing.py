"""Continuous landing: drops, restarts, broken records, batches run twice."""

import json

from rolecast.operators import ledger as LG
from rolecast.sources import boards as B
from rolecast.streaming import landing as LA


def test_each_file_counts_once(spark, tmp_path):
    sources = {"export": LA.Landed(f"{tmp_path}/export", B.EXPORT_SCHEMA, B.user_export),
               "board": LA.Landed(f"{tmp_path}/board", B.EPOCH_SCHEMA, B.epoch_board)}
    root, n = f"{tmp_path}/log", 0

    def drop(source, *lines):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(f"{tmp_path}/{source}")

    def run():
        LA.land(spark, sources, root, f"{tmp_path}/offsets", files_per_batch=1).awaitTermination()
        return (sorted(tuple(r) for r in LA.postings(spark, root).select("source_label", "title").collect()),
                sorted(tuple(r) for r in LA.rejected(spark, root).select("source_label", "record").collect()))

    drop("export", json.dumps({"company": "A", "title": "Data Intern"}), "{broken")
    drop("board", json.dumps({"slug": "b", "id": "1", "text": "Harp Intern"}))
    first = ([("board", "Harp Intern"), ("export", "Data Intern")], [("export", "{broken")])
    assert run() == first
    assert run() == first  # a restart without new files
    for i in range(5):
        drop("board", json.dumps({"slug": "b", "id": str(i), "text": f"Lute Intern {i}"}), "", "also broken")
    second = run()
    assert second[0] == sorted(first[0] + [("board", f"Lute Intern {i}") for i in range(5)])
    assert second[1] == sorted(first[1] + [("board", "also broken")] * 5)
    # The union is what a batch over all files gives.
    good, _ = B.split_corrupt(B.read_payloads(spark, f"{tmp_path}/board", B.EPOCH_SCHEMA))
    assert B.epoch_board(good).count() == 6
    assert len(LG.live_sets(spark, root, LA.POSTINGS)) < 7
    # A batch that is run again replaces its rows, also when they were merged with others.
    again = LA.postings(spark, root).where("batch = 1").collect()
    rows = spark.createDataFrame(again, LA.POSTING_SCHEMA)
    LG.replace_run(spark, root, 1, {LA.POSTINGS: rows}, run_column={LA.POSTINGS: "batch"})
    assert LA.postings(spark, root).count() == len(second[0])
