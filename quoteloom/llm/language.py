"""Languages of documents and of their paragraphs, by nearest centroid over character n-grams.

A bounded sample of labelled rows gives segments (sentences, cut at two thousand characters); their normalised
TF-IDF n-gram vectors give several clustered centroids a language, labels that disagree with their neighbours
left out. Every segment of every document is compared with all centroids by cosine; one too far from all is
rejected and has no vote. A paragraph has the language of most of its letters, a document that of the paragraphs
with most letters together.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteloom.llm.topn import top_n

#: Codes and the spellings of each, region suffixes aside.
LABELS: dict[str, list[str]] = {
    "en": ["en", "eng", "english"],
    "ca": ["ca", "cat", "catalan", "català", "valencian"],
    "cy": ["cy", "cym", "wel", "welsh", "cymraeg"],
    "da": ["da", "dan", "danish", "dansk"],
    "de": ["de", "deu", "ger", "german", "deutsch"],
    "es": ["es", "spa", "esp", "spanish", "español", "castilian", "castellano"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais"],
    "it": ["it", "ita", "italian", "italiano"],
    "nl": ["nl", "nld", "dut", "dutch", "nederlands", "flemish"],
    "pl": ["pl", "pol", "polish", "polski"],
    "pt": ["pt", "por", "portuguese", "português", "portugues"],
    "sv": ["sv", "swe", "swedish", "svenska"],
}
CODES = [*LABELS]
#: Everyday and polite sentences of each language, which give it a further centroid; they stand in no label.
SEEDS: dict[str, str] = {
    "en": "Thank you for your patience. Thank you in advance. Please reply by Friday. Please contact us as soon as possible. Kind regards, the claims team. Best wishes, your insurance team. Yours sincerely. Dear customer, we look forward to hearing from you. Have a nice day. See you next week. This is not what we have said and it will be sent to you today.",
    "ca": "Moltes gràcies per la vostra paciència. Gràcies per endavant. Si us plau, responeu abans de divendres. Poseu-vos en contacte amb nosaltres al més aviat possible. Salutacions cordials, el departament de sinistres. Atentament, el vostre equip d'assegurances. Benvolgut client, quedem a l'espera de la vostra resposta. Que tingueu un bon dia. Fins la setmana que ve. Això no és el que hem dit i us ho enviarem avui.",
    "cy": "Diolch am eich amynedd. Diolch ymlaen llaw. Atebwch cyn dydd Gwener os gwelwch yn dda. Cysylltwch â ni cyn gynted â phosibl. Cofion gorau, y tîm hawliadau. Yn gywir, eich tîm yswiriant. Annwyl gwsmer, edrychwn ymlaen at glywed gennych. Cael diwrnod da. Gwelwn ni chi yr wythnos nesaf. Nid dyma a ddywedwyd gennym a bydd yn cael ei anfon atoch heddiw.",
    "da": "Tak for din tålmodighed. På forhånd tak. Svar venligst inden fredag. Kontakt os venligst hurtigst muligt. Med venlig hilsen, skadeafdelingen. De bedste hilsner, dit forsikringsteam. Kære kunde, vi ser frem til at høre fra dig. Hav en god dag. Vi ses i næste uge. Det er ikke det, vi har sagt, og det bliver sendt til dig i dag.",
    "de": "Vielen Dank für Ihre Geduld. Vielen Dank im Voraus. Bitte antworten Sie bis Freitag. Bitte melden Sie sich so bald wie möglich bei uns. Mit freundlichen Grüßen, Ihre Schadenabteilung. Beste Grüße, Ihr Versicherungsteam. Sehr geehrter Kunde, wir freuen uns auf Ihre Antwort. Einen schönen Tag noch. Bis nächste Woche. Das ist nicht, was wir gesagt haben, und es wird Ihnen heute zugesandt.",
    "es": "Muchas gracias por su paciencia. Gracias de antemano. Responda antes del viernes, por favor. Póngase en contacto con nosotros lo antes posible. Un cordial saludo, el departamento de siniestros. Atentamente, su equipo de seguros. Estimado cliente, quedamos a la espera de su respuesta. Que tenga un buen día. Hasta la semana que viene. Esto no es lo que hemos dicho y se lo enviaremos hoy.",
    "fr": "Merci de votre patience. Merci d'avance. Merci de répondre avant vendredi. Veuillez nous contacter dès que possible. Cordialement, le service des sinistres. Bien à vous, votre équipe d'assurance. Cher client, nous restons dans l'attente de votre réponse. Bonne journée. À la semaine prochaine. Ce n'est pas ce que nous avons dit et cela vous sera envoyé aujourd'hui.",
    "it": "Grazie per la vostra pazienza. Grazie in anticipo. Rispondete entro venerdì, per favore. Vi preghiamo di contattarci al più presto. Cordiali saluti, l'ufficio sinistri. Distinti saluti, la vostra squadra assicurativa. Gentile cliente, restiamo in attesa di una vostra risposta. Buona giornata. Alla prossima settimana. Questo non è quello che abbiamo detto e vi sarà inviato oggi.",
    "nl": "Dank u voor uw geduld. Bij voorbaat dank. Graag antwoord voor vrijdag. Neem zo snel mogelijk contact met ons op. Met vriendelijke groet, de schadeafdeling. Hartelijke groeten, uw verzekeringsteam. Geachte klant, wij kijken uit naar uw reactie. Nog een fijne dag. Tot volgende week. Dit is niet wat wij hebben gezegd en het wordt u vandaag toegestuurd.",
    "pl": "Dziękujemy za cierpliwość. Z góry dziękujemy. Prosimy o odpowiedź do piątku. Prosimy o jak najszybszy kontakt. Z poważaniem, dział likwidacji szkód. Pozdrawiamy, zespół ubezpieczeń. Szanowny kliencie, czekamy na odpowiedź. Miłego dnia. Do zobaczenia w przyszłym tygodniu. To nie jest to, co powiedzieliśmy, i zostanie wysłane dzisiaj.",
    "pt": "Obrigado pela sua paciência. Agradecemos desde já. Responda até sexta-feira, por favor. Entre em contacto connosco o mais breve possível. Com os melhores cumprimentos, o departamento de sinistros. Atenciosamente, a sua equipa de seguros. Caro cliente, ficamos a aguardar a sua resposta. Tenha um bom dia. Até à próxima semana. Isto não é o que dissemos e será enviado hoje para si.",
    "sv": "Tack för ditt tålamod. Tack på förhand. Vänligen svara före fredag. Kontakta oss så snart som möjligt. Med vänliga hälsningar, skadeavdelningen. Bästa hälsningar, ditt försäkringsteam. Bästa kund, vi ser fram emot att höra från dig. Ha en bra dag. Vi ses nästa vecka. Det är inte vad vi har sagt och det kommer att skickas till dig i dag.",
}
NONE = "und"
BITS = 15
SIZE = 1 << BITS
ORDERS = (2, 3, 4)
SEGMENT = 2_000
#: Characters classified together: few enough that what they gather stays in the processor's cache.
CHUNK = 8_000
#: Cosine to the nearest centroid, and lead over the next language, below which a segment is rejected.
LEAST_COSINE, LEAST_LEAD = 0.06, 0.01

_END = re.compile(r"(?<=[.!?;:])\s+|\n+")
_CODE = re.compile(r"(?<!\S)[^\s\d]*+\d\S*")
_DIGIT = re.compile(r"\d")
_OTHER = re.compile(r"[^\w'· \n][^\w'·\n]*|_")
_LINE = re.compile(r"\r\n|\n|\r")
_VISIBLE = re.compile(r"[^\s\u0000-\u001f\u007f- ­ ᠎ -‏ -  -⁯⠀　ㅤ﻿]")


def label_code(label: Column) -> Column:
    """The code a label names, in any of its spellings and with any region; null where it names none."""
    first = F.element_at(F.split(F.lower(F.trim(label)), r"[-_ (]"), 1)
    spelt = F.create_map(*[F.lit(x) for code, words in LABELS.items() for w in words for x in (w, code)])
    return F.try_element_at(spelt, first)


def paragraphs(text: str) -> list[str]:
    """Runs of lines with something visible, parted by lines without."""
    out: list[list[str]] = [[]]
    for line in _LINE.split(text):
        if _VISIBLE.search(line):
            out[-1].append(line)
        elif out[-1]:
            out.append([])
    return ["\n".join(p) for p in out if p]


def segments(paragraph: str) -> list[str]:
    """Normalised sentences: lower case, words with digits and signs left out; none where no letters remain."""
    parts = _END.split(paragraph)
    if len(paragraph) > SEGMENT:
        parts = [s[k : k + SEGMENT] for s in parts for k in range(0, len(s), SEGMENT)]
    # one sentence a line, so that each pattern runs once over them all
    t = "\n".join(parts).lower()
    t = _OTHER.sub(" ", _CODE.sub(" ", t) if _DIGIT.search(t) else t)
    return [x for x in (" ".join(s.split()) for s in t.split("\n")) if x]


def unaccented(text: str) -> str:
    t = text.replace("ł", "l").replace("ø", "o").replace("æ", "ae").replace("ß", "ss").replace("ð", "d")
    return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, bucket, count) of the hashed n-grams of texts, sorted by segment; each text is framed by blanks."""
    framed = [f" {t} " for t in texts]
    codes = np.frombuffer("".join(framed).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) for t in framed])
    keys = []
    for n in ORDERS:
        if len(codes) < n:
            continue
        h = np.zeros(len(codes) - n + 1, dtype=np.uint64)
        for k in range(n):
            h = (h ^ codes[k : len(codes) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h += np.uint64(n)
        whole = owner[: len(h)] == owner[n - 1 :]
        bucket = ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int64)
        keys.append((owner[: len(h)] << BITS | bucket)[whole])
    key, count = np.unique(np.concatenate(keys) if keys else np.empty(0, np.int64), return_counts=True)
    return key >> BITS, key & (SIZE - 1), count.astype(np.float32)


class Model:
    """Centroids (bucket x centroid), the language of each, and the inverse document frequencies."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, language: np.ndarray):
        order = np.argsort(language, kind="stable")  # a language's centroids side by side
        self.idf, self.language = idf.astype(np.float32), language[order]
        self.centroids = np.ascontiguousarray(centroids[:, order], dtype=np.float32)  # a bucket's values side by side
        self.present, self.first = np.unique(self.language, return_index=True)
        self.gathered = np.empty((0, self.centroids.shape[1]), dtype=np.float32)  # written over by every chunk

    def cosines(self, texts: list[str]) -> np.ndarray:
        """(texts x languages of CODES): the cosine to the nearest centroid of each language; -1 without any."""
        out = np.full((len(texts), len(CODES)), -1.0, dtype=np.float32)
        start = 0
        while start < len(texts):
            stop, n = start, 0
            while stop < len(texts) and (stop == start or n + len(texts[stop]) <= CHUNK):
                n += len(texts[stop]) + 2
                stop += 1
            seg, bucket, count = features(texts[start:stop])
            if len(seg):
                w = count * self.idf[bucket]
                first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
                if len(self.gathered) < len(bucket):
                    self.gathered = np.empty((2 * len(bucket), self.centroids.shape[1]), dtype=np.float32)
                rows = np.take(self.centroids, bucket, axis=0, out=self.gathered[: len(bucket)], mode="clip")
                dots = np.empty((len(first), rows.shape[1]), dtype=np.float32)
                for k, (a, b) in enumerate(zip(first.tolist(), [*first[1:].tolist(), len(seg)])):
                    np.dot(w[a:b], rows[a:b], out=dots[k])
                norm = np.sqrt(np.add.reduceat(w * w, first))
                cos = dots / np.maximum(norm, 1e-9)[:, None]
                out[np.ix_(start + seg[first], self.present)] = np.maximum.reduceat(cos, self.first, axis=1)
            start = stop
        return out


def _centroids(seg, bucket, w, group, n_groups) -> np.ndarray:
    """Normalised sums of the segments' unit vectors by group; group -1 takes no part."""
    g = group[seg]
    keep = g >= 0
    m = np.bincount(g[keep] * SIZE + bucket[keep], weights=w[keep], minlength=n_groups * SIZE).reshape(n_groups, SIZE)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)


def _dots(seg, bucket, w, centroids, n) -> np.ndarray:
    out = np.zeros((n, len(centroids)), dtype=np.float32)
    for k, c in enumerate(centroids):
        out[:, k] = np.bincount(seg, weights=w * c[bucket], minlength=n)
    return out


def fit(rows: list[tuple[str, str]], *, clusters: int = 4, rounds: int = 4) -> Model:
    """A model from (code, text). Segments nearer to another language than their label's are left out round by round.

    Every language has one centroid of the seed sentences and up to ``clusters`` of the sample's segments. Without
    any labelled text there is no model: everything is rejected.
    """
    texts, labels = [], []
    for code, text in rows:
        for p in paragraphs(text):
            for t in segments(p):
                if len(t) >= 20:
                    plain = unaccented(t)
                    texts += [t] if plain == t else [t, plain]
                    labels += [CODES.index(code)] * (1 if plain == t else 2)
    if not texts:
        return Model(np.ones(SIZE), np.zeros((SIZE, 0)), np.zeros(0, dtype=np.int64))
    sampled = len(texts)
    for code, text in SEEDS.items():
        for t in segments(text):
            texts += [t, unaccented(t)]
            labels += [CODES.index(code)] * 2
    seg, bucket, count = features(texts)
    n, label = len(texts), np.array(labels)
    seeds = np.arange(n) >= sampled
    idf = np.log((1 + n) / (1 + np.bincount(bucket, minlength=SIZE))) + 1
    w = count * idf[bucket]
    w = w / np.maximum(np.sqrt(np.bincount(seg, weights=w * w, minlength=n)), 1e-9)[seg]
    group = label.copy()
    for _ in range(rounds):
        nearest = _dots(seg, bucket, w, _centroids(seg, bucket, w, group, len(CODES)), n).argmax(axis=1)
        group = np.where((nearest == label) | seeds, label, -1)
    parts, language = [], []
    for k in range(len(CODES)):
        own = np.flatnonzero((group == k) & ~seeds)
        parts.append(_centroids(seg, bucket, w, np.where(seeds & (label == k), 0, -1), 1))
        language.append(k)
        if not len(own):
            continue
        c = min(clusters, len(own))
        place = np.full(n, -1)
        place[own] = np.arange(len(own))
        here = place[seg] >= 0
        s_, b_, w_ = place[seg[here]], bucket[here], w[here]
        member = np.arange(len(own)) % c
        for _ in range(5):
            member = _dots(s_, b_, w_, _centroids(s_, b_, w_, member, c), len(own)).argmax(axis=1)
        parts.append(_centroids(s_, b_, w_, member, c))
        language += [k] * c
    return Model(idf, np.concatenate(parts).T, np.array(language))


def labelled_sample(documents: DataFrame, per_language: int = 120) -> list[tuple[str, str]]:
    """(code, text) of at most ``per_language`` labelled documents a language: the bound of what the model is fitted on."""
    labelled = documents.select("doc_id", label_code(F.col("lang")).alias("code")).where("code is not null").withColumn("h", F.xxhash64("doc_id"))
    chosen = top_n(labelled, ["code"], [F.col("h"), F.col("doc_id")], ["doc_id"], per_language).select("doc_id", "code")
    rows = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")  # per_language rows a code
    return sorted((r.code, r.text) for r in rows.select("code", "text").collect())


def detect(documents: DataFrame, model: Model, *, columns: list[str] | None = None) -> DataFrame:
    """(doc_id, para_no, lang, doc_lang, confidence, letters, + columns): a row a paragraph, and para_no 0 for the whole document.

    The confidence is the share of letters that speak for the language times their mean lead over the next
    language, 0 to 1. Null and empty texts, and those without letters, are ``und`` with confidence 0 and have
    no paragraph rows beyond their visible ones.
    """
    extra = columns or []
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: Model = sent.value
        for pdf in batches:
            for part in range(0, len(pdf), 1000):
                rows = pdf.iloc[part : part + 1000]
                texts, place, paras = [], [], []
                for d, text in enumerate(rows["text"]):
                    for p, para in enumerate(paragraphs(text) if isinstance(text, str) else [], 1):
                        paras.append((d, p))
                        for t in segments(para):
                            texts.append(t)
                            place.append(len(paras) - 1)
                known = len(m.language) > 0 and texts
                size = np.array([len(t) - t.count(" ") - t.count("'") - t.count("·") for t in texts], dtype=float)
                cos = m.cosines(texts) if known else np.full((len(texts), len(CODES)), -1.0)
                votes = np.zeros((len(paras), len(CODES)))
                leads = np.zeros((len(paras), len(CODES)))
                if known:
                    order = np.argsort(cos, axis=1)
                    best = order[:, -1]
                    top = cos[np.arange(len(texts)), best]
                    second = np.maximum(cos[np.arange(len(texts)), order[:, -2]], 0)
                    lead = np.clip((top - second) / np.maximum(top, 1e-9), 0, 1)
                    ok = (top >= LEAST_COSINE) & (top - second >= LEAST_LEAD) & (size > 0)
                    at = np.array(place)
                    np.add.at(votes, (at[ok], best[ok]), size[ok])
                    np.add.at(leads, (at[ok], best[ok]), (size * lead)[ok])
                size_of = np.zeros(len(paras))
                np.add.at(size_of, np.array(place, dtype=int), size)
                # by paragraph, then by document, without a loop over either
                at_doc, para = np.array([d for d, _ in paras], dtype=np.int64), np.array([p for _, p in paras], dtype=np.int64)
                best = votes.argmax(axis=1) if len(paras) else np.empty(0, np.int64)
                voted = votes.sum(axis=1) > 0
                lead_of = np.where(voted, leads[np.arange(len(paras)), best], 0.0)
                by_doc, lead_doc, total_doc = np.zeros((len(rows), len(CODES))), np.zeros((len(rows), len(CODES))), np.zeros(len(rows))
                np.add.at(by_doc, (at_doc[voted], best[voted]), size_of[voted])
                np.add.at(lead_doc, (at_doc[voted], best[voted]), lead_of[voted])
                np.add.at(total_doc, at_doc, size_of)
                top_doc = by_doc.argmax(axis=1)
                some = by_doc.max(axis=1) > 0
                names = np.array([*CODES, NONE], dtype=object)
                doc_lang = names[np.where(some, top_doc, len(CODES))]
                who = np.concatenate([at_doc, np.arange(len(rows))])
                got = pd.DataFrame({
                    "doc_id": rows["doc_id"].to_numpy()[who],
                    "para_no": np.concatenate([para, np.zeros(len(rows), np.int64)]),
                    "lang": np.concatenate([names[np.where(voted, best, len(CODES))], doc_lang]),
                    "doc_lang": doc_lang[who],
                    "confidence": np.concatenate([lead_of / np.maximum(size_of, 1), np.where(some, lead_doc[np.arange(len(rows)), top_doc] / np.maximum(total_doc, 1), 0.0)]),
                    "letters": np.concatenate([size_of, total_doc]).astype(np.int64),
                })
                for c in extra:
                    got[c] = rows[c].to_numpy()[who]
                yield got[["doc_id", "para_no", "lang", "doc_lang", "confidence", "letters", *extra]]

    kinds = ", ".join(f"{c} {documents.schema[c].dataType.simpleString()}" for c in extra)
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, para_no int, lang string, doc_lang string, confidence double, letters int" + (f", {kinds}" if kinds else "")
    return documents.select("doc_id", "text", *extra).mapInPandas(run, schema)


def language_issues(documents: DataFrame, *, per_language: int = 120) -> DataFrame:
    """(doc_id, para_no, lang, confidence): para_no 0 where the label names no language or another than the
    document's, 1 and up for paragraphs in another language than their document's.

    Documents and paragraphs that are rejected give no row. Repeated rows repeat; an empty table gives none.
    """
    model = fit(labelled_sample(documents, per_language))
    labelled = documents.select("doc_id", "text", label_code(F.col("lang")).alias("label"))

    found = detect(labelled, model, columns=["label"]).where(F.col("lang") != NONE)
    wrong = F.when(F.col("para_no") == 0, F.col("label").isNull() | (F.col("label") != F.col("lang"))).otherwise(F.col("lang") != F.col("doc_lang"))
    return found.where(wrong).select("doc_id", "para_no", "lang", "confidence")
