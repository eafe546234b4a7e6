"""The subpackage's queries are all there: an import error would drop them from the entry in silence."""

import __spark_entry__ as entry


def test_every_operator_and_the_pipeline_are_registered():
    found = set(entry.queries())
    numbers = {int(name[2:].split("_")[0]) for name in found if name.startswith("op") and name[2].isdigit()}
    assert numbers == set(range(1, 14)) and "pipeline" in found
    assert {"op9_mixing", "op12_ranked_search"} <= set(entry.oracle_sql())
