"""Scripts and the rows they give."""

import pytest

from positdb.engine import Engine
from positdb.errors import ExecutionError, ParseError
from positdb.plans.syntax import parse

# A flat changes hands: who rents it from whom, and what both call themselves over the years.
LEASES = """
add role tenant, landlord, goes by;
add posit [{(+t, tenant), (+l, landlord)}, "lets", '2011-03-01'],
          [{(t, tenant), (l, landlord)}, "gives notice", '2016-10-31'],
          [{(t, tenant), (l, landlord)}, "lets", '2019-05'],
          [{(t, goes by)}, "Ines Okafor", '1985'],
          [{(t, goes by)}, "Ines Okafor-Lind", '2014-07-12'],
          [{(l, goes by)}, "Lind & Sons", '1990-02'],
          [{(l, goes by)}, "Lind Estates", '2018-01-15'];
"""
SCALES = """add role weight, trust, remark;
    add posit [{(+crate, weight)}, 40, '2020'], [{(+box, weight)}, 7, '2020'], [{(+sack, weight)}, 40.0, '2020'],
              [{(+x, trust)}, 20%, '2020'], [{(+y, trust)}, 90%, '2020'], [{(crate, remark)}, "fragile", '2020'];"""
LAUNCHES = "add role launch; add posit [{(+first, launch)}, \"weather\", '1998-11-20'], [{(+second, launch)}, \"radio\", '2005-02'];"


def rows(spark, setup, script):
    engine = Engine(spark)
    engine.run(setup)
    return sorted(map(tuple, engine.execute_collect(script).rows))


def test_both_members_of_a_union_answer(spark):
    """Each row asks for the names of either party; a later search starts anew, with the as-of filter."""
    found = Engine(spark).execute_collect_multi(LEASES + """
        search [{(+a, tenant), (+b, landlord)}, "gives notice", *], [{(a|b, goes by)}, +n, +t] return n, t;
        search [{(+c, tenant), (+d, landlord)}, +deal, +since] as of '2017', [{(c|d, goes by)}, +n, *] return n, deal, since;""")
    assert [f.row_count for f in found] == [4, 4]
    assert {tuple(r[1:]) for r in found[1].rows} == {("gives notice", "2016-10-31")}


@pytest.mark.parametrize(
    ("patterns", "expected"),
    [
        # The literal comes after the snapshot: today the lease runs again.
        ("""[{(+a, tenant), (+b, landlord)}, "gives notice", *] as of @NOW, [{(a|b, goes by)}, +n, +t]""", []),
        ("""[{(+a, tenant), (+b, landlord)}, "gives notice", +at] as of '2018', [{(a|b, goes by)}, +n, +t] as of at""", [("Ines Okafor-Lind", "2014-07-12"), ("Lind & Sons", "1990-2")]),
        ("""[{(+a, tenant), (+b, landlord)}, "lets", +at] as of '2012', [{(a|b, goes by)}, +n, +t] as of at""", [("Ines Okafor", "1985"), ("Lind & Sons", "1990-2")]),
        ("""[{(+a, tenant), (+b, landlord)}, "lets", +at] as of @NOW, [{(b, goes by)}, +n, +t] as of at""", [("Lind Estates", "2018-01-15")]),
        ("""[{(+a, tenant), (+b, landlord)}, "lets", *] as of '2017', [{(a|b, goes by)}, +n, +t]""", []),
    ],
)
def test_names_as_of_a_lease(spark, patterns, expected):
    assert rows(spark, LEASES, f"search {patterns} return n, t;") == expected


def test_names_until_a_lease(spark):
    script = """search [{(+a, tenant), (+b, landlord)}, "gives notice", +at], [{(a|b, goes by)}, +n, +t] where t <= at return n;"""
    assert rows(spark, LEASES, script) == [("Ines Okafor",), ("Ines Okafor-Lind",), ("Lind & Sons",)]


def test_history_carried_along_counts_ties_and_precision(spark):
    """A settled set of appearances is joined as of a variable by its last posit: of equal times the first added."""
    setup = """add role ask, answer; add posit [{(+a, ask)}, 1, '2020-05'], [{(+b, ask)}, 1, '2020-05-10'],
        [{(a, answer)}, "first", '2020-05'], [{(a, answer)}, "second", '2020-05'], [{(a, answer)}, "later", '2020-06-01'],
        [{(b, answer)}, "coarse", '2020-05'], [{(b, answer)}, "fine", '2020-05-01'], [{(b, answer)}, "too late", '2020-05-11'];"""
    assert rows(spark, setup, "search [{(+x, ask)}, *, +t], [{(x, answer)}, +v, *] as of t return t, v;") == [("2020-05-10", "fine"), ("2020-5", "first")]


def test_order_and_equality_of_numbers(spark):
    two = "search [{(*, weight)}, +a, *], [{(*, weight)}, +b, *] where a %s b return a, b;"
    assert rows(spark, SCALES, two % "<") == [("7", "40"), ("7", "40.0")]
    assert rows(spark, SCALES, two % "=") == [("40", "40"), ("40", "40.0"), ("40.0", "40"), ("40.0", "40.0"), ("7", "7")]
    assert rows(spark, SCALES, "search [{(*, weight)}, +a, *] where a >= 40 return a;") == [("40",), ("40.0",)]
    mixed = SCALES + "add role code; add posit [{(+k, code)}, \"7\", '2020'], [{(+m, code)}, 40.00, '2020'];"
    assert rows(spark, mixed, "search [{(*, code)}, +a, *], [{(*, weight)}, +b, *] where a = b return a, b;") == [("40.00", "40"), ("40.00", "40.0"), ("7", "7")]


def test_certainties(spark):
    assert rows(spark, SCALES, "search [{(*, trust)}, +a, *], [{(*, trust)}, +b, *] where a > b return a, b;") == [("0.90", "0.20")]
    for text, n in (("= 20%", 1), ("= 020%", 1), ("= 0.20", 0), ("= 20", 0), ("> 90%", 0), (">= 90%", 1), ("<= 100%", 2)):
        assert len(rows(spark, SCALES, f"search [{{(*, trust)}}, +c, *] where c {text} return c;")) == n, text


@pytest.mark.parametrize(
    ("search", "message"),
    [
        ("[{(*, trust)}, +c, *] where c < 50 return c", "percent sign"),
        ("[{(*, remark)}, +r, *] where r >= 1 return r", "Ordering comparison not allowed"),
        ("[{(*, remark)}, +r, *], [{(*, remark)}, +s, *] where r > s return r", "Ordering comparison not allowed"),
        ("[{(*, trust)}, +c, *], [{(*, weight)}, +w, *] where c > w return c", "Ordering comparison"),
        ("[{(*, weight)}, +w, *] where heavy = 40 return w", "Unknown variable in predicate: heavy"),
        ("[{(*, weight)}, +w, *] return heavy", "Unknown variable in return: heavy"),
        ("[{(nobody, weight)}, +w, *] return w", "not bound in a prior command"),
        ("[{(*, colour)}, +w, *] return w", "Unknown role"),
        ("[{(*, weight)}, +w, *] as of then return w", "needs a time variable"),
        ("[{(*, weight)}, +w, +w] return w", "a value and a time"),
        ("[{(*, weight)}, +w, +t] where w = t return w", "not both times"),
    ],
)
def test_errors(spark, search, message):
    with pytest.raises(ExecutionError, match=message):
        Engine(spark).execute_collect(SCALES + f"search {search};")


@pytest.mark.parametrize(
    ("where", "expected"),
    [
        ("t < '2000'", ["1998-11-20"]),
        ("t > '1998-11-19'", ["1998-11-20", "2005-2"]),
        ("t >= '2005-02-14'", ["2005-2"]),  # the month ends after it
        ("t > '2005-02-14'", []),  # but does not begin after it
        ("t <= '1998'", ["1998-11-20"]),
        ("t >= '1998-11-20' and t <= '1998-11-20'", ["1998-11-20"]),
        ("t > '1999' and t < '2005'", []),
        ("never = '1999'", []),  # a variable without times compares with none
    ],
)
def test_times(spark, where, expected):
    assert rows(spark, LAUNCHES, f"search [{{(*, launch)}}, +v, +t] where {where} return t;") == [(e,) for e in expected]


def test_times_of_two_patterns_and_of_the_slot(spark):
    assert rows(spark, LAUNCHES, "search [{(*, launch)}, +v, +s], [{(*, launch)}, +w, +t] where s < t return v, w;") == [("weather", "radio")]
    assert rows(spark, LAUNCHES, "search [{(*, launch)}, +v, '2005-02'] return v;") == [("radio",)]


def test_limits(spark):
    engine = Engine(spark)
    engine.run("add role rank; " + "".join(f"add posit [{{(+p{i}, rank)}}, {i}, '2020'];" for i in range(5)))
    found = engine.execute_collect_multi("search +p [{(*, rank)}, +n, *] return p, n limit 3; search [{(*, rank)}, +n, *] return n limit 5; search [{(*, rank)}, +n, *] return n limit 9;")
    assert [(f.row_count, f.limited) for f in found] == [(3, True), (5, True), (5, False)]
    assert [r[1] for r in found[0].rows] == ["0", "1", "2"]
    assert engine.execute_collect("search [{(*, rank)}, +n, *] return n limit 0;").row_count == 0


def test_assertions_about_posits(spark):
    script = """add role keeper, dog, called;
        add posit +p [{(+k, keeper), (+d, dog)}, "owns", '2012-04-02'], [{(p, posit), (k, ascertains)}, 65%, '2013'], [{(d, called)}, "Biscuit", '2012'];
        add posit [{(+k2, keeper), (+d2, dog)}, "owns", '2015'];
        search +q [{(*, keeper), (+x, dog)}, "owns", *], [{(q, posit), (*, ascertains)}, +c, *], [{(x, called)}, +n, *] return n, c;"""
    found = Engine(spark).execute_collect(script)
    assert found.rows == [["Biscuit", "0.65"]] and found.row_types == [["String", "Certainty"]]


def test_added_variables_hold_sets(spark):
    script = """add role shape, colour;
        add posit [{(+i, shape)}, "circle", '2001'], [{(+i, shape)}, "square", '2002'];
        add posit [{(i, colour)}, "red", '2003'];
        search [{(i, colour)}, *, *], [{(i, shape)}, +s, *] return s;
        search [{(*, colour)}, +c, *] return c;"""
    found = Engine(spark).execute_collect_multi(script)
    assert sorted(found[0].rows) == [["circle"], ["square"]] and found[1].row_count == 2


def test_same_variable_twice_and_wildcards(spark):
    script = """add role a, b;
        add posit [{(+x, a), (x, b)}, 1, '2001'], [{(+y, a), (+z, b)}, 2, '2001'];
        search [{(+v, a), (v, b)}, +n, *] return n;
        search [{(+v, *)}, 2, *] return v;
        search [*, +n, *] return n;"""
    found = Engine(spark).execute_collect_multi(script)
    assert [f.row_count for f in found] == [1, 2, 2]


def test_values_and_display(spark):
    script = """add role k;
        add posit [{(+a, k)}, "say ""hi"" /* no comment */", @BOT], [{(+b, k)}, { "b": [1, {"c": 2}], "a": "x" }, '2004-05'],
                  [{(+c, k)}, 3.1415926535897932384626433832795028841971693993751, '2004'], [{(+d, k)}, -5%, '2004-05-01 10:00'], [{(+e, k)}, '2001-02', @EOT],;
        search [{(*, k)}, +v, +t] return v, t;
        search [{(*, k)}, {"a":"x","b":[1,{"c":2}]}, +t] return t;
        search [{(*, k)}, +v, *] where v = "say ""hi"" /* no comment */" return v;
        search [{(*, k)}, +v, *] where v < '2002' return v;"""
    found = Engine(spark).execute_collect_multi(script)
    assert {r[1] for r in found[0].rows} == {"BOT", "2004-5", "2004", "2004-05-01 10:00:00", "EOT"}
    assert "-0.05" in {r[0] for r in found[0].rows}
    assert [f.row_count for f in found[1:]] == [1, 1, 1]


def test_parse_errors():
    with pytest.raises(ParseError, match="line 2, column 1"):
        parse("add role a;\nfind x;")
    with pytest.raises(ParseError, match="a variable"):
        parse("search [{(*, name)}, +limit, *] return n;")
    with pytest.raises(ParseError):
        parse("search [{(*, name)}, +n, *];")
