"""Arrays of laboratory tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardbook import fixed_values as fv
from wardbook.functions.json_text import parsed_object
from wardbook.schemas import LAB_TEST

_TESTS_DDL = f"array<{LAB_TEST.simpleString()}>"


# How every list of tests, or a single one, starts. Each text the JSON reader has to
# give up on costs an exception; this spares most of them.
_MAY_BE_TESTS = r"^\s*(\[\s*[\[{\]n]|\{\s*[\"}])"
_STRICT = {"allowSingleQuotes": "false"}
# A list inside a list inside an object, with room for the text if it is damaged anywhere.
_WHOLE_DDL = f"struct<lists: array<{_TESTS_DDL}>, damaged: string>"
_WHOLE = {**_STRICT, "columnNameOfCorruptRecord": "damaged"}


def parse_tests(text: Column) -> Column:
    """JSON text to an array of tests; unreadable or absent text gives ``[]``.

    A list whose only closing bracket is its last character is read once, in brackets, where
    text behind it is damage or a second element. What is no plain list of tests is looked at a
    second time, to tell damaged text from values of another type: the reader keeps what it
    can of either.
    """
    maybe = F.when(text.rlike(_MAY_BE_TESTS), text)
    simple = F.when(F.instr(maybe, "]") == F.length(F.rtrim(maybe)), maybe)
    wrapped = F.concat(F.lit('{"lists":['), simple, F.lit("]}"))
    whole = F.from_json(wrapped, _WHOLE_DDL, _WHOLE)

    def only_list(read: Column) -> Column:
        return F.when(read["damaged"].isNull() & (F.size(read["lists"]) == 1), read["lists"][0])

    # As the one element of an array, so that it is read once for all its uses.
    plain = F.transform(F.array(whole), only_list)[0]
    checked = F.when(parsed_object(maybe).isNotNull(), F.from_json(maybe, _TESTS_DDL, _STRICT))
    return F.coalesce(plain, checked, F.array().cast(_TESTS_DDL))


def lab_lines(tests: Column, separator: str = fv.LAB_LINE_SEPARATOR) -> Column:
    """One line of text per test, joined by ``separator``."""

    def line(test: Column) -> Column:
        name, value, normal, status = (F.coalesce(test[f], F.lit("")) for f in LAB_TEST.names)
        return F.concat(
            F.lit("- "), name, F.lit(": "), value,
            F.lit(" (Normal: "), normal, F.lit(") - Status: "), status,
        )

    return F.array_join(F.transform(tests, line), separator)


def test_severity(status: Column, screen: str = "patient") -> Column:
    """Severity class of a test status, as each screen shows it."""
    normal = status == "NORMAL"
    if screen == "laboratory":
        return F.when(normal, "ok").otherwise("warn")
    graded = F.when(normal, "ok").when(status.isin("HIGH", "LOW"), "warn")
    if screen == "doctor":
        return graded.otherwise("fail")
    if screen == "patient":
        return graded.when(status == "FAIL", "fail").otherwise("neutral")
    raise ValueError(f"unknown screen: {screen}")


def severities(tests: Column, screen: str = "patient") -> Column:
    """Severity class of every test in the array."""
    return F.transform(tests, lambda test: test_severity(test["status"], screen))


def first_tests(tests: Column, shown: int = 2) -> Column:
    """the first tests of a report."""
    return F.slice(tests, 1, shown)


def hidden_tests(tests: Column, shown: int = 2) -> Column:
    """A5: how many tests the short form leaves out."""
    return F.greatest(F.size(F.coalesce(tests, F.array())) - shown, F.lit(0))


def more_label(tests: Column, shown: int = 2) -> Column:
    """A5: ``+N more tests``, null when nothing is left out."""
    hidden = hidden_tests(tests, shown)
    return F.when(hidden > 0, F.concat(F.lit("+"), hidden.cast("string"), F.lit(" more tests")))


def append_pending_test(lab_tests: Column, test: Column) -> Column:
    """add a requested test to a draft's list, starting one if needed."""
    known = F.coalesce(lab_tests, F.array().cast("array<string>"))
    return F.array_append(known, F.concat(test, F.lit(fv.PENDING_TEST_SUFFIX)))
