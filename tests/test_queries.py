"""Every query against its SQL on whole small tables, and the stability of the general problems' queries."""

from concurrent.futures import ThreadPoolExecutor

import pytest

import __spark_entry__ as entry
import variants
from oracle import difference, rows_of
from tidemark.plans import problems
from tidemark.scale import shared_dir

LLM = set()
try:
    from tidemark.llm import queries as _llm

    LLM = set(_llm.QUERIES)
except ImportError:
    pass
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def ahead(request, spark, small, copies):
    """Results of the selected tests by their ids, computed by a few threads: small queries mostly wait for planning."""
    shared_dir(spark)
    work = {
        "test_query_equals_sql": lambda name: difference(spark, QUERIES[name], SQL[name], small),
        "test_query_runs": lambda name: QUERIES[name](spark, small).count(),
        "test_empty_tables_give_nothing": lambda name: result(spark, name, copies["empty"]),
        "test_dirt_changes_nothing": lambda name, variant: (result(spark, name, copies[variant]), result(spark, name, small)),
    }
    with ThreadPoolExecutor(6) as pool:
        chosen = [i for i in request.session.items if i.module is request.module and i.originalname in work]
        yield {i.name: pool.submit(work[i.originalname], **i.callspec.params) for i in chosen}


@pytest.mark.parametrize("name", sorted(set(SQL) - LLM))
def test_query_equals_sql(ahead, request, name):
    assert ahead[request.node.name].result()[0] == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - LLM))
def test_query_runs(ahead, request, name):
    assert ahead[request.node.name].result() >= 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["generation_id", "security_id", "change_kind"]


def result(spark, name, at):
    df = problems.QUERIES[name](spark, at)
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    root = tmp_path_factory.mktemp("variants")
    return {f.__name__: variants.write(root / f.__name__, f) for f in (variants.empty, variants.with_nulls, variants.twice, variants.clashing)}


@pytest.mark.parametrize("name", sorted(problems.QUERIES))
def test_empty_tables_give_nothing(ahead, request, name):
    assert not ahead[request.node.name].result()[1]


@pytest.mark.parametrize("variant", ["with_nulls", "twice", "clashing"])
@pytest.mark.parametrize("name", sorted(problems.QUERIES))
def test_dirt_changes_nothing(ahead, request, name, variant):
    got, want = ahead[request.node.name].result()
    assert got == want
