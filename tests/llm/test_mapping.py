import pytest

from quoteloom.llm import mapping as m

NAMES = ["Harbour Mutual", "Harbourline", "Keystead", "Orchard & Vane", "Silverthorn", "Kestrel Home", "Candlewick", "Northvale"]
ALIASES = {("s", "HM"): "Candlewick", ("t", "HM"): "Keystead", ("s", "Core"): "Northvale", ("t", "Premier"): "Silverthorn"}
TYPES = {"detached": "detached", "detached house": "detached", "semi": "semi_detached", "semi detached": "semi_detached", "terraced": "terraced", "mid terrace": "terraced", "end terrace": "end_terrace", "flat": "flat", "apartment": "flat", "bungalow": "bungalow", "semi detached bungalow": "bungalow", "semi_detached": "semi_detached", "end_terrace": "end_terrace"}


@pytest.mark.parametrize("spec,text,want", [
    ("s", "KEYSTEAD", "Keystead"), ("s", "Keystaed", "Keystead"), ("s", "K3ystead Insurance Ltd", "Keystead"), ("s", "Kystd", "Keystead"), ("s", "Vane, Orchard", "Orchard & Vane"), ("s", "orchard and vane", "Orchard & Vane"),
    ("s", "Candlew", "Candlewick"), ("s", "Càndlewick", "Candlewick"), ("s", "HM", "Candlewick"), ("t", "hm", "Keystead"), ("u", "HM", m.UNMATCHED), ("s", "Core Insurance", "Northvale"), ("t", "Core", m.UNMATCHED),
    ("s", "Northgate Motor", m.UNMATCHED), ("s", "Silverton Savings", m.UNMATCHED), ("s", "", m.UNMATCHED), ("s", "  ", m.UNMATCHED), ("s", "n/a", m.UNMATCHED), ("s", "Harbour", m.UNMATCHED), ("s", "quote from Kestrel Home", "Kestrel Home"),
    ("s", "Kestrel Home Home Insurance", "Kestrel Home"), ("s", "Kestlre Home - home", "Kestrel Home"), ("s", "Silvaforn", "Silverthorn"), ("s", "0800 Candlewick (ref 7)", "Candlewick"), ("s", "x" * 5000, m.UNMATCHED),
])
def test_brands(spec, text, want):
    assert m.brand_mapper(NAMES, ALIASES, {})(spec, text) == want


@pytest.mark.parametrize("text,want", [
    ("Detached House", "detached"), ("detatched", "detached"), ("semi-det house", "semi_detached"), ("sem-idetached", "semi_detached"), ("END OF TERRACE", "end_terrace"), ("en terraced house", "end_terrace"), ("mid-trrace (3 bed)", "terraced"), ("terracedhouse", "terraced"),
    ("dormer bungalow.", "bungalow"), ("studioflat", "flat"), ("lighthouse", m.UNMATCHED), ("park home", m.UNMATCHED), ("houseboat", m.UNMATCHED), ("", m.UNMATCHED), ("end fo terrace", "end_terrace"), ("smi detached house", "semi_detached"), ("stand-alonehouse", "detached"), ("end terracedhouse", "end_terrace"),
])
def test_types(text, want):
    assert m.type_mapper(TYPES)("", text) == want


def test_distance():
    assert m.weighted_distance("abc", "abc") == 0 and m.weighted_distance("abcd", "abdc") == pytest.approx(0.8) and m.weighted_distance("hello", "helllo") == pytest.approx(0.5)
    assert m.weighted_distance("flat", "garage", 2.0) > 2.0


def test_ties_go_to_the_more_frequent():
    book = m.Dictionary(["carta", "cartb"], {"cartb": 5})
    assert book.near("cartm", 2.0)[0] == "cartb"
    assert m.Dictionary(["carta", "cartb"]).near("cartp", 2.0)[0] == "carta"


def test_table(spark):
    q = spark.createDataFrame([(1, "s", "Keystead", "flat", "x"), (2, "s", None, None, "x"), (3, "s", "keystaed", "Semi", "x"), (3, "s", "keystaed", "Semi", "x"), (4, "s", "Keystead", "garage", "x")], "vq_id long, spec_name string, brand_text string, property_text string, text string")
    p = spark.createDataFrame([(n,) for n in NAMES], "brand string")
    a = spark.createDataFrame([(s, t, b) for (s, t), b in ALIASES.items()], "spec_name string, alias_text string, brand string")
    t = spark.createDataFrame([(v, k) for k, v in TYPES.items()], "building_type string, wording string")
    got = sorted(map(tuple, m.map_values(q, p, a, t).collect()))
    assert got == sorted([(3, "brand", "Keystead"), (3, "building_type", "semi_detached")] * 2 + [(4, "building_type", m.UNMATCHED)])
    assert m.map_values(q.limit(0), p, a, t).count() == 0


def test_types_come_from_the_list():
    """A type the list adds is reached, and one it lacks is not, without any word of it elsewhere."""
    more = m.type_mapper(TYPES | {"lighthouse": "tower", "water tower": "tower"})
    assert more("", "old lighthuose") == "tower" and more("", "watter tower") == "tower" and more("", "semi detached house") == "semi_detached"
    assert m.type_mapper({"flat": "flat"})("", "bungalow") == m.UNMATCHED


def test_shuffled_join_gives_the_same(spark):
    q = spark.createDataFrame([(k, "s", t, "semi") for k, t in enumerate(["Keystaed", "HM", "zzz", None] * 3)], "vq_id long, spec_name string, brand_text string, property_text string")
    p = spark.createDataFrame([(n,) for n in NAMES], "brand string")
    a = spark.createDataFrame([(s, t, b) for (s, t), b in ALIASES.items()], "spec_name string, alias_text string, brand string")
    t = spark.createDataFrame([(v, k) for k, v in TYPES.items()], "building_type string, wording string")
    rows = lambda **how: sorted(map(tuple, m.map_values(q, p, a, t, **how).collect()))
    assert rows() == rows(max_bytes=0) and len(rows()) == 21
