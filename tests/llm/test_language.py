import pytest
from pyspark.sql import functions as F

from quoteloom.llm import language as L

TEXT = {
    "en": "The surveyor asked about the broken garden wall before any work began. The tenant has refused to accept the settlement offer without an appointment.",
    "es": "El perito describe el estado de la caldera antes de la renovación. El inquilino rechazó la reparación del tejado sin coste adicional.",
    "de": "Der Eigentümer begrenzt die Kosten einer Ersatzwohnung vor der Verlängerung. Der Gutachter beschreibt die Reparatur des Daches ohne Zusatzkosten.",
    "da": "Taksatoren begrænser skader efter stormen og desuden reparation af taget. Ejeren har afvist udgifterne til genhusning uden ekstra omkostninger.",
}


@pytest.fixture(scope="module")
def model():
    return L.fit([(c, t) for c, t in TEXT.items()] * 3 + [("es", TEXT["en"])])


def test_paragraphs_and_segments():
    assert L.paragraphs("a\nb\n \t\r\n​\nc\n\n\n") == ["a\nb", "c"]
    assert L.paragraphs("") == [] and L.paragraphs(" \n ") == []
    assert L.segments("See AB12 3CD: £4,000 due. Æble og pære!") == ["see", "due", "æble og pære"]
    assert max(map(len, L.segments("x" * 9000))) == L.SEGMENT


def test_labels(spark):
    rows = [("en-GB", "en"), ("EN", "en"), (" eng ", "en"), ("Portuguese", "pt"), ("ger", "de"), ("de_AT", "de"), ("und", None), ("", None), (None, None), ("unknown", None), ("Cymraeg", "cy")]
    df = spark.createDataFrame(rows, "l string, w string")
    assert all(r.got == r.w for r in df.withColumn("got", L.label_code(F.col("l"))).collect())


def test_found_languages(spark, model):
    docs = [
        (1, TEXT["en"] + "\n\n" + TEXT["es"], "en"), (2, TEXT["de"], "da"), (3, L.unaccented(TEXT["da"]).upper(), None), (4, None, "en"), (5, "", "en"), (6, "12 / 34\n\n£5", "xx"),
        (7, "\n\n".join([TEXT["es"]] * 2 + [TEXT["en"] + " " + TEXT["es"] * 2]), "spa"), (8, ("The surveyor asked about the wall. " * 3000), "English"), (2, TEXT["de"], "da"),
    ]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, label string, lang_ string")
    got = L.detect(df, model, columns=["label"]).collect()
    by = {(r.doc_id, r.para_no): r for r in got}
    assert by[1, 0].lang == "en" and by[1, 2].lang == "es" and by[1, 2].doc_lang == "en"
    assert by[2, 0].lang == "de" and by[3, 0].lang == "da" and by[8, 0].lang == "en" and by[7, 3].lang == "es"
    assert by[4, 0].lang == by[5, 0].lang == by[6, 0].lang == L.NONE and by[6, 0].confidence == 0
    assert sum(r.doc_id == 2 and r.para_no == 0 for r in got) == 2 and all(0 <= r.confidence <= 1 for r in got)


def test_issues(spark):
    docs = [(k, TEXT[c], c) for k, c in enumerate(list(TEXT) * 5)] + [(100, TEXT["en"], "es"), (101, TEXT["en"] + "\n\n" + TEXT["de"][:74], "en-GB"), (102, TEXT["da"], "und")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, lang string, para_no int")
    got = {(r.doc_id, r.para_no, r.lang) for r in L.language_issues(df).collect()}
    assert got == {(100, 0, "en"), (101, 2, "de"), (102, 0, "da")}
    assert L.language_issues(df.limit(0)).count() == 0


def test_held_out_accuracy(spark):
    import pyarrow.parquet as pq

    d = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text", "lang"]).to_pandas()
    train, test = d[d.doc_id % 2 == 0], d[d.doc_id % 2 == 1]
    rows = [(r.lang, r.text) for r in train.itertuples() if r.lang in L.CODES]
    model = L.fit([(c, t) for c in L.CODES for c2, t in rows if c2 == c][:600])
    mostly = [(r.lang, L.segments(r.text)) for r in test.itertuples() if r.lang in ("en", "fr", "de")]
    right = sum(L.CODES[model.cosines(s).sum(axis=0).argmax()] == c for c, s in mostly if s)
    assert right / len(mostly) > 0.9  # a tenth of the labels are wrong or the texts mixed
