import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bitloom.llm import names as N

AGENTS = [(1, "Ingrid Velphetov", "person"), (2, "Ruth Velphetov", "person"), (3, "Emil G. Wexrudoley", "person"), (4, "Yevgenia Branböloholt", "person"), (5, "Kringisson Audio Workshop", "organisation"), (6, "Belnemiwald Optics Foundation", "organisation"), (7, "William Selbovåquist", "person"), (9, "Victoria Selbovåquist", "person")]
REGISTRY = N.Registry(AGENTS)


def osa(a: str, b: str) -> int:
    """Optimal string alignment distance."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abcd", min_size=1, max_size=10), min_size=1, max_size=15), st.text("abcd", min_size=1, max_size=10))
def test_trie_against_brute_force(words, probe):
    most = 0 if len(probe) < 3 else 1 if len(probe) < 8 else 2
    assert N.Trie(iter(words)).near(probe) == {w: d for w in words if (d := osa(probe, w)) <= most}


@pytest.mark.parametrize(
    ("written", "agents"),
    [
        ("VELPHETOV Ingrid", [1]), ("Velphetov, R.", [2]), ("Igrid Velphetow", [1]), ("Dr. Ruth  Velphetov (arr.)", [2]), ("by Emil Wexrudoley", [3]), ("Emil G. Wexrudoly, ed.", [3]),
        ("Zhenya Branboeloholt", [4]), ("(c) Yevgenia_Branboloholt", [4]), ("Kringisson Aud. Wkshp", [5]), ("Workshop of Kringisson Audio", [5]), ("Kringisson A. W.", [5]), ("Kringisson Audio Workshop Ltd", [5]),
        ("The Belnemiwld Opt.", [6]), ("Belnemiwald Optics", [6]), ("Wm. Selbovåkwist", [7]), ("W. Selbovåquist", [7]), ("Selbovåquist, V.", [9]), ("Ingrid Velphetov & Emil Wexrudoley", [1, 3]), ("I. Velphetov feat. Kringisson Audio Workshop", [1, 5]),
        ("Hugo Velphetov", []), ("Velphetov", []), ("Kringisson Media Workshop", []), ("Emil B. Wexrudoley", []), ("various", []), ("", []), ("&", []), ("x" * 10_000, []),
    ],
)
def test_written_forms(written, agents):
    assert [hits[0][0] for p in N.parts(written) if len(hits := REGISTRY.link(p)) == 1] == agents


@pytest.mark.parametrize("shard", [20_000, 2])
def test_link_names(spark, monkeypatch, shard):
    monkeypatch.setattr(N, "SHARD_AGENTS", shard)
    agents = spark.createDataFrame([*AGENTS, (8, None, "person")], "agent_id long, agent_name string, agent_kind string")
    rows = [(1, "Velphetov, R."), (2, "Velphetov, R."), (3, None), (4, ""), (5, "nobody at all"), (6, "Emil Wexrudoley; Kringisson Audio Workshop")]
    df = spark.createDataFrame(rows, "item_id long, value string")
    got = {(r["value"], r["agent_id"]) for r in N.link_names(df, agents).collect()}
    assert got == {("Velphetov, R.", 2), ("Emil Wexrudoley; Kringisson Audio Workshop", 3), ("Emil Wexrudoley; Kringisson Audio Workshop", 5)}
    assert N.link_names(df.limit(0), agents).count() == 0 and N.link_names(df, agents.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("written", "agents"),
    [
        ("Mei Ng", [1]), ("Ng, M.", [1]), ("SIEMENS", [2]), ("Siemns", [2]), ("Intl Paper Works", [3]), ("Int. Paper Wks", [3]), ("Paper Works", []), ("Mike Brown", [4]), ("Brown", []),
        ("Royal Northern Society of Very Long Organisation Names", [5]), ("; ".join(["Nobody Known"] * 200 + ["Mei Ng"]), [1]),
    ],
)
def test_short_single_and_long_names(written, agents):
    registry = N.Registry([(1, "Mei Ng", "person"), (2, "Siemens", "organisation"), (3, "International Paper Works", "organisation"), (4, "Michael Brown", "person"), (5, "Royal Northern Society of Very Long Organisation Names", "organisation")])
    assert [hits[0][0] for p in N.parts(written) if len(hits := registry.link(p)) == 1] == agents


def test_short_forms_are_a_parameter():
    agents = [(1, "Bartolomiej Kowal", "person")]
    assert not N.Registry(agents, {}).link("Bartek Kowal") and N.Registry(agents, {"bartolomiej": "bartek"}).link("Bartek Kowal") == [(1, 0)]


def test_shards_give_equal_results(spark, monkeypatch):
    """Ties and near agents in other shards: 1, 2 and 7 shards give the same links."""
    agents = spark.createDataFrame([(1, "Anna Keller", "person"), (2, "Anna  Keller", "person"), (3, "Anna Kelles", "person"), (4, "Paul Weber", "person"), (5, "Pavla Webber", "person"), (6, "Otto Maier", "person"), (7, "Otto Meier", "person")], "agent_id long, agent_name string, agent_kind string")
    df = spark.createDataFrame([(x,) for x in ("Anna Keller", "Anna Kelles", "A. Keller", "Paul Weber", "P. Weber", "Otto Mayer", "Otto Maier")], "value string")
    got = []
    for size in (7, 4, 1):
        monkeypatch.setattr(N, "SHARD_AGENTS", size)
        got.append({tuple(r) for r in N.link_names(df, agents).collect()})
    assert got[0] == got[1] == got[2] and {r[0] for r in got[0]} == {"Anna Kelles", "Paul Weber", "P. Weber", "Otto Maier", "Otto Mayer"}
