"""Longer scripts of the kinds that users write."""

from positdb.engine import Engine

VAULT = """
/* who was where, and how sure are we */
add role person, place, alias, job, status, witness;
add posit
    [{(+kim, alias)}, "Kim", '1980'], [{(+lee, alias)}, "Lee", '1985-02'], [{(+vault, place)}, "vault", @BOT],
    +s1 [{(kim, person), (vault, job)}, "guard", '2020-01-01 08:00'],
    +s2 [{(lee, person), (vault, job)}, "visitor", '2020-01-01 08:30'],
    +s3 [{(lee, person), (vault, job)}, "thief", '2020-01-01 09:15:30'],;
add posit
    [{(s1, posit), (kim, ascertains)}, 100%, '2020-01-02'], [{(s3, posit), (kim, ascertains)}, 80%, '2020-01-02'],
    [{(s3, posit), (lee, ascertains)}, -100%, '2020-01-02'], [{(s3, posit), (kim, ascertains)}, 40%, '2020-03'];
"""


def ask(spark, search):
    return sorted(map(tuple, Engine(spark).execute_collect(VAULT + search).rows))


def test_certain_enough(spark):
    search = 'search +p [{(+x, person), (*, job)}, +j, *], [{(p, posit), (+who, ascertains)}, +c, +at], [{(who, alias)}, +n, *] where c >= 75% return j, n, c, at;'
    assert ask(spark, search) == [("guard", "Kim", "1", "2020-01-02"), ("thief", "Kim", "0.80", "2020-01-02")]


def test_latest_opinion(spark):
    search = "search +p [{(*, person), (*, job)}, \"thief\", *], [{(p, posit), (+who, ascertains)}, +c, +at] as of %s, [{(who, alias)}, +n, *] return n, c;"
    assert ask(spark, search % "'2020-02'") == [("Kim", "0.80"), ("Lee", "-1")]
    assert ask(spark, search % "@NOW") == [("Kim", "0.40"), ("Lee", "-1")]
    assert ask(spark, search % "'2019'") == []


def test_moments_and_coarser_times(spark):
    search = "search [{(+x, person), (+v, job)}, +j, +t] where t %s return j;"
    assert ask(spark, search % "< '2020-01-01 09:00'") == [("guard",), ("visitor",)]
    assert ask(spark, search % "= '2020-01-01 08:30'") == [("visitor",)]
    assert len(ask(spark, search % "<= '2020-01-01'")) == len(ask(spark, search % ">= '2020'")) == 3
    assert ask(spark, search % "> '2020'") == ask(spark, search % "== '2020'") == []


def test_trailing_commas_and_case(spark):
    search = "SEARCH [{(+x, person),}, +j, +t], [{(x, alias)}, +n, *], WHERE j = \"thief\" RETURN n, t, LIMIT 5;"
    assert ask(spark, search) == [("Lee", "2020-01-01 09:15:30")]


def test_recall_of_a_search(spark):
    found = Engine(spark).execute_collect_multi(VAULT + """
        search [{(+x, person)}, "thief", *] return x;
        search [{(x, alias)}, +n, *] return n;
        add posit [{(x, status)}, "wanted", '2020-01-02'];
        search [{(+y, status)}, "wanted", *], [{(y, alias)}, +n, *] return n;""")
    assert [f.rows for f in found[1:]] == [[["Lee"]], [["Lee"]]]


def test_posit_variable_as_thing(spark):
    search = "search +p [{(*, person), (*, job)}, *, *], +q [{(p, posit), (*, ascertains)}, -100%, *] return p, q;"
    rows = ask(spark, search)
    assert len(rows) == 1 and rows[0][0] != rows[0][1]


def test_shared_posit_variable_and_empty_patterns(spark):
    assert ask(spark, "search +p [{(*, job)}, +j, *], +p [{(*, person)}, *, +t] where j = \"guard\" return t;") == [("2020-01-01 08:00:00",)]
    assert ask(spark, "search [{(+x, witness)}, *, *], [{(*, alias)}, +n, *] return n;") == []
    assert ask(spark, "search [{(+x, alias), (x, person)}, *, *] return x;") == []
