import os

from millrace import session


def test_settled_keeps_the_result_and_deletes_what_it_was_made_of(spark):
    made = []

    def make():
        inner = session.stored(spark, spark.range(10), "inner")
        made.append(inner.inputFiles())
        return inner.where("id > 6")

    out = session.settled(spark, make, "outer")
    assert sorted(r["id"] for r in out.collect()) == [7, 8, 9]
    assert made[0] and not any(os.path.exists(f.removeprefix("file://")) for f in made[0])
    with session.scratch(spark):
        held = session.settled(spark, make, "outer").inputFiles()
    assert not any(os.path.exists(f.removeprefix("file://")) for f in held)
