import pytest

from cartolith import __main__ as command
from tests import fixtures
from tests.test_stores import _blob, _block


@pytest.fixture(scope="module")
def extract(spark, tmp_path_factory):
    """The yards as an extract."""
    rows = lambda df: [tuple([tuple(x) for x in v] if c in ("tags", "members") else v for c, v in zip(df.columns[1:], r[1:])) for r in df.orderBy("seq").collect()]
    n, w, rel = (rows(t) for t in fixtures.yards(spark))
    path = tmp_path_factory.mktemp("extract") / "yards.pbf"
    path.write_bytes(_blob(b"OSMData", _block(n)) + _blob(b"OSMData", _block((), (), w)) + _blob(b"OSMData", _block((), (), (), rel)))
    return str(path)


def test_build_and_plan(spark, extract, tmp_path):
    store = f"file://{tmp_path}/store"
    run = lambda *args: command.run(spark, command.parser().parse_args([str(a) for a in args])).collect()
    assert run("build", extract, store)[0].asDict() == {"cameras": 4, "places": 4}
    half = fixtures.STEP / 2
    got = run("plan", store, 0.9 * half, fixtures.LON + 0.02, -0.9 * half, fixtures.LON + 0.02)
    assert [r.weight for r in got] == [0.0, 1.0, 2.0, 4.0, 8.0]
    assert all(r.status == "OK" and r.length_m == pytest.approx(100.1) and r.percent == pytest.approx(27.3) and r.nodes == 2 for r in got)


def test_compare(spark, extract):
    box = (-fixtures.STEP, fixtures.LON - 0.001, fixtures.STEP, fixtures.LON + 0.001)
    args = command.parser().parse_args(["compare", extract, "--pairs", "60", "--seed", "3", "--box", *map(str, box)])
    a, b = command.run(spark, args).first(), command.run(spark, args).first()
    assert a == b and a.planned == 60 and a.higher == a.skipped == 0
    # yard 0 is hidden by its house: every walk along it drops to nothing
    assert 0 < a.lower < 60 and a.mean_with == 0 and a.largest_drop == pytest.approx(6 / 22) and a.same == 60 - a.lower
