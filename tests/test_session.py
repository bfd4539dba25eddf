"""Tables written on the way: which go, and when."""

import os
import threading

from lexforge.session import Block, Scratch, materialize, read_note, remove, shared_dir, write_note


def there(spark):
    at = shared_dir(spark).removeprefix("file://")
    return set(os.listdir(at)) if os.path.isdir(at) else set()


def test_a_block_takes_its_tables_along(spark):
    before = there(spark)
    with Block(spark) as outer:
        with Scratch(spark) as scratch:
            materialize(spark, spark.range(3), "inner")
            scratch.write(spark.range(2), "part")
            kept = scratch.keep(spark.range(5), "result")
        assert kept.count() == 5 and len(there(spark) - before) == 1
        last = outer.keep(kept, "last")
    assert last.count() == 5 and {x.split("-")[0] for x in there(spark) - before} == {"last"}
    remove(spark, outer.kept)
    assert there(spark) == before


def test_settings_come_back_after_the_last_thread(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    inside, go = threading.Event(), threading.Event()

    def other():
        with Scratch(spark):
            inside.set()
            go.wait(20)

    thread = threading.Thread(target=other)
    with Scratch(spark):
        thread.start()
        assert inside.wait(20)
    assert spark.conf.get(name) == "2000"
    go.set()
    thread.join()
    assert spark.conf.get(name) == was


def test_notes(spark):
    path = os.path.join(shared_dir(spark), "folder", "_note")
    assert read_note(spark, path) is None
    write_note(spark, path, "12")
    assert read_note(spark, path) == "12"
    remove(spark, os.path.dirname(path))
