"""What a build writes of the lines of a corpus, and where keywords are found in them."""

import re

from conftest import records
from st_files import corpus

from plcatlas.operators import extract
from plcatlas.plans import index_job


def test_a_build_writes_no_branches(spark, monkeypatch):
    written, cut = [], index_job.cut_lineage
    monkeypatch.setattr(index_job, "cut_lineage", lambda rows: (written.append(rows.columns), cut(rows))[1])
    text = "PROGRAM P\nVAR s : INT; END_VAR\nCASE s OF\n 1: s := 2;\nEND_CASE\nEND_PROGRAM\n"
    declared = index_job.declarations(corpus(spark, {"a.st": text}), index_job.Options(1))
    assert records(declared.variables, "name", "var_type") == [("s", "INT")]
    assert "declared" in written[0] and not {"case_of", "label", "moves"} & set(written[0])


def test_first_letters_of_keywords():
    """Each keyword that a pattern looks for begins with one of the letters it tests first, in either case."""
    for pattern, words in (
        (extract._EDGE, [*extract.SECTIONS, "STRUCT", "END_X"]), (extract._ALONE, [*extract.SECTIONS, "STRUCT", "END_VAR"]),
        (extract._HEAD, [f"{kind} A" for kind in (*extract.OUTER_KINDS, *extract.INNER_KINDS, "TYPE")]),
    ):
        assert "(?=[" in pattern
        for word in words:
            for text in (word, word.lower(), f"a; {word}"):
                assert re.search(pattern.replace("(?:\\n|\\z)", "(?:\\n|\\Z)"), text), (pattern, text)
