"""Residue, and prose or code that only looks like it."""

import pytest

from codeloom.llm import prefilter, residue

BODY = "The reader keeps one page in memory. It writes the rest to disk. Nobody waits for it. A second reader may follow. Both share the index."


@pytest.mark.parametrize(
    "text",
    [
        "Welcome to {{ project_name }}, maintained by the team.",
        BODY + "\nDear ${owner}, thanks for reporting <project_name>.",
        "# [YOUR TEAM]\n\nContact __VERSION__ when %(team)s is down.",
        "This guide describes <%= OWNER %> for release @@version@@.",
        "Fixes #$team$",
        "Expected behaviour: <!-- what you expected to happen -->",
        BODY + "\n\nLorem ipsum dolor sit amet consectetur adipiscing elit.",
        "Title\n\nSome text goes here. Swap it out before publishing.",
        "Dummy summary.",
        "asdf asdf qwer foo bar foo hjkl",
        "Hier folgt noch Text, bitte ersetzen.",
        "404 Not Found",
        "Home | Docs | Sign in\n\nYour session has expired. Log in again to continue.",
        "<html><head><title>503 Service Unavailable</title></head><body><h1>503 Service Unavailable</h1></body></html>",
        '{"error": {"code": 403, "message": "forbidden", "trace": "5bd0"}}',
        "Seite nicht gefunden.",
        "You need to enable JavaScript to run this app.",
        "<noscript>This page works only with JavaScript turned on</noscript>",
        "Habilite JavaScript en su navegador para continuar.",
        "This app relies on JS.",
    ],
)
def test_residue(spark, text):
    df = spark.createDataFrame([(1, text), (2, BODY)], "doc_id long, text string")
    assert [r["doc_id"] for r in residue.residue(df).collect()] == [1]


@pytest.mark.parametrize(
    "text",
    [
        BODY,
        "In the template, `{{ name }}` is replaced when the page is rendered.",
        '```js\nconst url = `${base}/${id}`;\n```\nThe call above returns 404 Not Found for unknown ids.',
        "Generic code such as `Vec<T>` is printed with its brackets.",
        "We replaced the lorem ipsum text in the demo by real records.",
        'Users who saw "Something went wrong" had an expired key; the job now renews it.',
        "The gateway answered 502 Bad Gateway for 35 % of the calls until we raised the limit.",
        "The viewer checks whether JavaScript is enabled and otherwise falls back to the static list.",
        "TODO for the next release: the job should skip a file that has no owner.",
        "A sample never stores its rows unless the missing gateway tests them.",
        None,
        "",
    ],
)
def test_no_residue(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").selectExpr("*", "'clash' as kind", "'x' as skeleton")
    assert residue.residue(df).count() == 0


def test_aligned_templates(spark):
    rows = [(n, f"{BODY}\nWelcome to {{{{ {v} }}}}, maintained by us.") for n, v in enumerate(["team", "OWNER", "version"])]
    rows += [(9, "Welcome to Acme, maintained by us."), (0, rows[0][1])]
    got = {r["doc_id"]: r for r in residue.residue(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {0, 1, 2} and got[1]["template_docs"] == 3 and got[1]["kinds"] == ["slot"] and got[1]["n_slots"] == 1


def test_errors_in_a_text_with_content_are_no_page(spark):
    df = spark.createDataFrame([(1, BODY + " " + BODY + "\nAccess denied.\n" + BODY)], "doc_id long, text string")
    assert residue.residue(df).count() == 0


def test_values_without_marks_are_aligned(spark):
    people = ["Ann Lee", "Bob", "Carl Ort", "Dora"]
    rows = [(n, f"{BODY}\nMaintainer: {p}\nRelease: {n}.x\n\nThis part is kept by {p} for the readers.") for n, p in enumerate(people)]
    rows += [(10, rows[0][1].replace("Maintainer: Ann Lee", "Maintainer: OWNER_NAME")), (11, rows[1][1].replace("Release: 1.x", "Release: "))]
    rows += [(12, rows[2][1].replace("kept by Carl Ort for", "kept by team_name for")), (13, "Set MAX_ROWS to 5.\nSteps:\nRun it.")]
    got = {r["doc_id"]: r["kinds"] for r in residue.residue(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {10: ["slot"], 11: ["slot"], 12: ["slot"]}


@pytest.mark.parametrize(
    "passage", ["You need to enable JavaScript to run this app.", "Something went wrong. Please try again later.", "The {{page}} was not found: {{page}} not found"]
)
def test_pages_pasted_into_long_texts(spark, passage):
    df = spark.createDataFrame([(1, f"{BODY} {BODY}\n{passage}\n{BODY}"), (2, BODY)], "doc_id long, text string")
    assert [r["doc_id"] for r in residue.residue(df).collect()] == [1]


@pytest.mark.parametrize(
    "text",
    ["The page cannot be found.", "The page could not be found.", "This link can't be found.", "This file could not be found on this server.", "(Error 404)", "Text to come later", "Oops! Something broke.", "test test test test", "word word word word", "This page requires JS", "Some words will follow.", "Check whether JavaScript is enabled in your browser.", "Thıs page requires javaſcript"],
)
def test_no_prefilter_hides_a_match(spark, text):
    df = spark.createDataFrame([(1, text), (2, BODY)], "doc_id long, text string")
    assert [r["doc_id"] for r in residue.residue(df).collect()] == [1]


def test_each_alternative_has_a_trigger():
    for pattern in (residue.SLOT, residue.FILLER, residue.ERROR, residue._ANSWER, residue.SCRIPT, residue._CHROME):
        assert prefilter.required(pattern) and prefilter.required(pattern)  # each pattern as a whole
        assert prefilter.Guarded(pattern).required <= residue.triggers.strings


def test_same_with_and_without_the_prefilter(spark, monkeypatch):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").select("text").collect()]
    segments = {s for t in texts for s in residue.segments(t)}
    quick = {s: residue.describe(s)[0] for s in segments}

    class Whole:
        def __init__(self, pattern):
            self.found = lambda text, here: bool(pattern.search(text))

    for name, pattern in {"_SLOT": residue.SLOT, "_FILLER": residue.FILLER, "_ERROR": residue.ERROR, "_ANSWERS": residue._ANSWER, "_SCRIPT": residue.SCRIPT, "_CHROMES": residue._CHROME}.items():
        monkeypatch.setattr(residue, name, Whole(pattern))
    monkeypatch.setattr(residue, "triggers", lambda segment: set(residue._RESIDUE | residue._FILL))
    assert quick == {s: residue.describe(s)[0] for s in segments}


def test_alternatives():
    assert prefilter.alternatives(r"a|b(c|d)|[|\]]|\||[^]|]x|") == ["a", "b(c|d)", r"[|\]]", r"\|", "[^]|]x", ""]


def test_alignment_alone_finds_rows(spark, monkeypatch):
    """Nothing but the comparison with other records of the template tells that a value was left open."""
    rows = [(n, f"{BODY}\nContact: {p}\nThe area lead is {p} for now.") for n, p in enumerate(["Ann Lee", "Bob", "Carl Ort", "Dora"])]
    rows += [(10, rows[0][1].replace("Contact: Ann Lee", "Contact: LEAD_NAME")), (11, rows[1][1].replace("lead is Bob for", "lead is TBD for"))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in residue.residue(frame).collect()} == {10, 11}
    # the same values where no other record fills the place
    alone = spark.createDataFrame(rows[4:], "doc_id long, text string")
    assert residue.residue(alone).count() == 0
    monkeypatch.setattr(residue, "unfilled_slots", lambda d, held: spark.createDataFrame([], "doc_id long, frame long"))
    assert residue.residue(frame).count() == 0
