"""Notes as seeds: anchors by mode, keys that make a second run add nothing, refusals."""

import pytest
from test_operators import entry, rows

from stratakb.schemas import ENTRIES
from stratakb.sources import markdown


def test_seeds(spark):
    text = "- see `src/a.py` for the limits\n- nothing named here\n- in b.md and src/a.py\n- ../up.py is outside\n- nothing named here\n"
    notes = spark.createDataFrame([("n.md", text), ("empty.md", None)], "path string, text string")
    known = spark.createDataFrame([("src/a.py",), ("b.md",), ("../up.py",)], "path string")
    got = {r.body: (r.file, r.unanchored) for r in markdown.seeds(notes, known=known, mode="file").collect()}
    assert got == {"see `src/a.py` for the limits": ("src/a.py", False), "nothing named here": (None, True), "in b.md and src/a.py": ("b.md", False), "../up.py is outside": (None, True)}
    assert {r.file for r in markdown.seeds(notes, known=known, mode="none").collect()} == {None}
    with pytest.raises(ValueError, match="mode"):
        markdown.seeds(notes, mode="some")
    with pytest.raises(ValueError, match="kind"):
        markdown.seeds(notes, kind="rumour")
    found = markdown.seeds(notes, known=known).cache()
    stored = rows(spark, ENTRIES, entry("e", origin=found.where("body like 'see%'").first().origin))
    twin = found.where("body like 'in b%'").select("origin")
    assert {r.body[:2]: r.outcome for r in markdown.seed_outcomes(found, stored, twin).collect()} == {"se": "unchanged", "no": "seeded", "in": "refused", "..": "seeded"}
