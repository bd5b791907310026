"""Subject areas of documents, by labelling functions and a latent model that learns how far to trust them.

Every sentence is put to labelling functions for each subject:
- lexicon: how strongly its words go with the subject. The list of seed words below and the descriptions of the subjects only
  begin it: over all documents it is counted how often a word, or two in a row, stands in sentences or sections with seeds of
  a subject (and in documents rated so), and that share, with the seed as a prior, is the word's weight. So terms that no list
  holds are learned, and seeds that mean nothing here, as in figures of speech, lose their vote. A sentence most of whose
  words are too rare to be known is open, one of known words without a subject is general;
- section: other sentences of the same section with a plain vote;
- address: the share of the plain votes of the document's repository, over all its other documents;
- source: the same for the document's source.
The votes of a sentence on a subject form one of few patterns. An EM over the counts of all patterns of all documents learns
for each function how often it votes as it does where the subject is dealt with and where not, and gives each pattern its
posterior, those without a word of the subject included. A document has the subjects that a quarter of its sentences deal
with, more likely than not.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import written

# Seed words by subject in English, German and Spanish: a star stands for any ending, behind the bar those with other meanings as well.
LEXICON = {
    "astronomy": """astronom* astrophys* telescop* teleskop* galax* nebula* nebel comet* komet* asteroid* meteor* planet exoplanet* planeta* planeten* supernova* quasar* pulsar* cosmolog* kosmolog* observator* sternwarte*
        sternbild* constellation* eclips* finsternis* saturn jupiter venus mars neptun* uran martian lunar moon moons mond solsystem* spacecraft raumschiff* spaceship* satellit* starlight interstellar stellar parsec* lightyear* cosmic
        umlaufbahn* astronaut* cosmonaut* rover orbiter estrella* órbita* luna cúmulo* | orbit* star stars stern* sky himmel* cielo transit space sol sun sonne""",
    "law": """law laws lawyer* attorney* plaintiff* defendant* lawsuit* litigat* statut* jurisdicti* juris* verdict* tribunal* notar* magistrate* injunction* subpoena* affidavit* courtroom* judicia* legal* legislat* prosecut* barrister* solicitor* felony
        parole acquit* indict* testif* arbitrat* tort liabilit* clause* gdpr copyright* trademark* anwalt* anwält* gericht* urteil* kläger* klage* gesetz* haftung* rechtsan* vertrag* anhörung berufung zeuge* beklagt* notariat*
        abogad* demandante* cláusula* sentencia* testigo* jurisdicc* apelaci* juzgado* juez jueces ley leyes jurídic* penal | judge* court* appeal* contract* settlement* witness* hearing* trial* demand* case tenant* precedent*""",
    "sport": """sport* athlet* stadium* referee* goalkeep* quarterback* touchdown* football* soccer basketball* baseball* volleyball* handball* hockey tennis rugby cricket golf swimmer* swimming marathon* sprinter* olympi* champion* tournament* league*
        playoff* midfielder* striker* penalties teammate* medal* jersey overtime kickoff wicket regatta rowing gymnast* wrestl* schiedsrichter* torwart* elfmeter* stadion* mannschaft* spieler* liga trainer* turnier* fußball* staffel meisterschaft*
        árbitro* portero* penalti* estadio* atleta* entrenador* gol goles torneo* equipo* partido* fútbol jugador* | goal* match* draw sprint* coach* team* score* penalty ball race* pitch half game* runner* play*""",
    "medicine": """medic* medizin* patient* diagnos* prescri* dosage* dosis surgeon* surger* hospital* nurse* vaccin* symptom* anaesth* anesth* chemother* therap* oncolog* cardiolog* clinic* klinik* triage* allerg* tumour* tumor* cancer* diabet*
        antibiotic* pharmac* paediat* pediatr* physician* biopsy infect* virus* fever* pregnan* painkiller* kidney* insulin* epidem* krankenh* krankheit* arzt ärzt* rezept* dosierung* chirurg* impf* blut* herzfreq* pflege*
        paciente* receta* cirujan* vacuna* enfermer* enfermedad* médic* síntoma* salud sangre | doctor* ward* dose* drug* discharge* blood* heart* tissue* cell* health*""",
    "finance": """financ* finanz* overdraft* dividend* shareholder* mortgage* bank banks banking banco* investor* investment* accountant* accounting bookkeep* ledger* creditor* debtor* portfolio* treasur* fiscal* taxes taxation taxpayer* loan* interest-rate* bond bonds
        currency currencies equity equities broker* hedge* inflation invoic* payroll salary audit auditor* stockbroker* cashflow euro euros dollar* zins* hauptbuch bilanz* anleihe* steuer* kredit* wechselkurs* konto konten rechnung* aktie* buchhalt* schulden
        préstamo* dividendo* factura* impuesto* cartera* hipoteca* tasa tipo-de-interés acciones contab* moneda | account* tax stock profit* credit* interest* margin* balance* bono market* cash money cuenta""",
    "music": """music* musik* melod* chorus* chord* choir* chor orchest* symphon* sinfoni* sonata* concerto* violin* viola cello* guitar* gitarr* piano* pianist* flute* flöte* trumpet* drummer* octave* lyric* soprano* tenor baritone alto opera*
        refrain* stave* metronom* crescendo* quartet* songwriter* singer* sänger* harmony harmonies rhythm* rhythmus* tempo* partitur* tonart* violine* schlagzeug* akkord* lied lieder playlist* album*
        acorde* coro melodía* violín* partitura* orquesta* canción* canciones batería* guitarra* ritmo* cantante* | song* beat* bar bars bass drum* score* note* verse* scale* pitch key* record* conductor*""",
    "agriculture": """agricult* agrar* farm farms farmer* farming crop crops greenhouse* livestock* tractor* irrigat* fertili* orchard* vineyard* wheat barley maize corn rye oat oats harvest* ploug* plow* barn* cattle cow cows sheep goats pig pigs poultry
        pasture* hayfield* silage silo* grain* pest* herbicid* sowing seedling* agronom* dairy beekeep* traktor* saatgut dünge* ernte* weide* viehbestand* vieh bewässer* acker* landwirt* bauernhof* getreide
        fertilizante* cosecha* invernadero* riego ganad* suelo* semilla* cultivo* granja* agrícola* viñedo* trigo | soil* seed* field* milk* plant* yield* row""",
    "transport": """transport* railway* railroad* train-station* tram trams bus buses lorry lorries truck* motorway* highway* freight* cargo* ferry ferries harbour* harbor* airport* aerodrome* airline* aircraft* pilot* runway* passenger* commuter* cyclist*
        vessel* shipping shipment* container-ship* wagon* locomotive* toll tolls timetable* traffic* junction* bicycle* taxi* vehicle* fahrplan* flugplan* güter* bahnhof* buslinie* maut* hafen* fracht* lastwagen zug züge flughaf* verkehr* straßenb*
        autobús* autobuses peaje* vuelo* vagón* vagones estación* puerto* aeropuert* tren trenes camión* camiones carretera* tranvía* | train trains ship ships flight* road* bridge* conductor* platform* route* schedule* carga driver* gate*""",
    "energy": """energy energie* energía* electric* elektri* eléctric* turbin* inverter* photovolt* fotovolt* megawatt* kilowatt* gigawatt* substation* substations powerplant* solarpanel* reactor* nuclear uranium coal coal-plant petroleum gasoline diesel biogas hydropower hydroelectric
        geothermal* dam dams windfarm* wind-farm* thermostat* heat-pump* volt volts voltage ampere* generator* blackout* kraftwerk* windrad windräder stromnetz* umspann* wechselricht* wärmepump* zählerstand* netzfrequ* strom akku*
        subestaci* inversor* apagón* apagones contador* bomba-de-calor petróleo carbón nucleares | grid* batter* charg* power* fuel* meter* transformer* solar* wind outage* utility gas""",
    "tooling": """debugg* compil* linter* formatter* autocomplet* parser* syntax* refactor* rebase* ide ides codebase* toolchain* bytecode* tokeniz* lexer* namespace* stacktrace* breakpoint* changelog* git github monorepo* dependency dependencies makefile* reindex* unused-import
        type-checker* language-server* symbol-table* call-graph* dead-code merge-conflict* embedding* paketmanager* symboltabell* aufrufgraph* codeindex* depurador* compilador* analizador* gestor-de-paquetes editor-de-código | index* token* editor* build* import* package* symbol* module* workspace* code script* branch""",
}
SPLIT = re.compile(r"(?<=[.!?…])[\"')\]]*\s+(?=[^\s])")
SPEAKER = re.compile(r"^\s*(?:[-*+•]\s+|\d+[.)]\s+|>+\s*)*(?:(?:user|agent|assistant|system|human|bot|reviewer|author)\s*:\s*)?", re.I)
LOG = re.compile(r"^\s*(?:\[?\d{4}-\d\d-\d\d|\d\d:\d\d:\d\d|(?:DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|TRACE)\b|at [\w.$]+\(|Traceback|File \"|\$ |>>> |[0-9a-f]{2,}(?: [0-9a-f]{2,})+\s*$)|<\/?(?:details|summary|pre|code)\b")
CODE = re.compile(r"[{};]\s*$|^\s{4,}\S|^\s*(?:def|class|import|from|return|const|let|var|func|fn|if|for|while|with)\b.*[:({=]|\w\(.*\)\s*;?$|=>|==|:=|\w\[\"")
WORD = re.compile(r"[^\W\d_]+(?:['’][a-z]+)?(?:-[^\W\d_]+)*")
MOJIBAKE = re.compile(r"[ÃÂ][\u0080-\u00ff]")


#: A word votes plainly from this share of its sentences on, doubtfully from the other; what a seed counts, in sentences, before any are seen.
PLAIN, DOUBTFUL, SEED_WEIGHT = 0.5, 0.4, 8
SEED_SHARE = {2: 0.95, 1: 0.35}
#: What seeds in the same sentence count against those in the sentences around, and how far below the best share a plain vote may be.
OWN, NEAR = 0.4, 0.3
#: A word, or two in a row, is known if it is in so many documents, and in as many as this share of all sentences. So at most the words of a sentence, twice, over this share are.
LEAST, LEAST_SHARE = 5, 1e-4
#: Rated documents that are read at most; a hash decides which.
RATED = 10_000


#: Under this term stands the evidence of all sentences; a word that no seed names must have so many times its share of a subject.
BASE, LIFT = "*", 1.5


class Seeds:
    """Votes of the seed words: {subject number: 2 plain, 1 doubtful} of a word, or of several in a row."""

    def __init__(self, subjects: list[tuple[str, str]]):
        self.names = [name for name, _ in subjects]
        self.exact: dict[str, dict[int, int]] = {}
        self.stems: dict[str, dict[int, int]] = {}
        for n, (name, description) in enumerate(subjects):
            parts = LEXICON.get(name, "").split("|")
            own = [(w, 2) for w in parts[0].split()] + [(w, 1) for w in parts[-1].split() if len(parts) > 1]
            # What a description says is plain where there is no list; else it is in doubt.
            own += [(w.removesuffix("s") + "*" if len(w) > 4 else w, 1 if name in LEXICON else 2) for w in words_of(description) if len(w) > 3 and w not in GENERAL]
            for w, weight in own:
                into = self.stems if w.endswith("*") else self.exact
                at = into.setdefault(w.rstrip("*").replace("-", " "), {})
                at[n] = max(weight, at.get(n, 0))
        self.cache: dict[str, dict[int, int]] = {}
        self.voted: dict[tuple[str, ...], dict[int, set[int]]] = {}

    def of(self, term: str) -> dict[int, int]:
        if (hit := self.cache.get(term)) is None:
            hit = dict(self.exact.get(term, {}))
            for size in range(len(term), 2, -1):
                if more := self.stems.get(term[:size]):
                    hit = {**more, **hit}
                    break
            if len(self.cache) < 1_000_000:
                self.cache[term] = hit
        return hit


# Words that mean nothing in a description.
GENERAL = set("the and with from other their them people things matter matters moving itself about".split())
DEFAULT = [(name, "") for name in LEXICON]


@lru_cache(maxsize=100_000)
def words_of(sentence: str) -> tuple[str, ...]:
    """Words in small letters; code spans and addresses are left out."""
    s = re.sub(r"`[^`]*`|https?://\S+", " ", sentence.lower().replace("’", "'"))
    return tuple(w.removesuffix("'s") for w in re.findall(r"[^\W\d_]+(?:'[a-z]+)?", s))


@lru_cache(maxsize=100_000)
def terms_of(words: tuple[str, ...]) -> tuple[tuple[str, int, int], ...]:
    """(term, first, last word): words and pairs of words in a row; of equal ones the last."""
    pairs = [(f"{a} {b}", i, i + 1) for i, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    return tuple({t[0]: t for t in [*((w, i, i) for i, w in enumerate(words)), *pairs]}.values())


def sections(text: str) -> Iterator[list[str]]:
    """The sentences of a text, by section. Headings, code, logs and markup are no sentences; a heading begins a section."""
    if MOJIBAKE.search(text):
        text = MOJIBAKE.sub(_repaired, text)
    out: list[str] = []
    fence, details = "", False
    for line in text.replace("\r", "").split("\n"):
        bare = line.strip()
        if m := re.match(r"(`{3,}|~{3,})", bare):
            fence = "" if fence and bare.startswith(fence) else fence or m.group(1)
            continue
        if "<details" in bare:
            details = True
        if fence or details:
            details = details and "</details" not in bare
            continue
        if re.match(r"#{1,6}\s", bare) or re.fullmatch(r"[=\-*_]{2,}", bare):
            if out:
                yield out
            out = []
            continue
        if not bare or LOG.search(line):
            continue
        bare = SPEAKER.sub("", bare).strip()
        if not re.search(r"[.!?…:][\"')\]*_]*$", bare) and (CODE.search(line) or len(bare.split()) < 4):
            continue
        if re.search(r"[;{}]$|^\w+(?:\.\w+)*\(.*\)$|^[\w.\[\]\"']+\s*[+:]?=\s|^(?:for|with|if|def|while)\b.*:$", bare):
            continue
        out += [s for s in SPLIT.split(bare) if WORD.search(s)]
    if out:
        yield out


def _repaired(m: re.Match) -> str:
    try:
        return m.group().encode("latin-1").decode("utf-8")
    except UnicodeError:
        return m.group()


def seed_votes(words: tuple[str, ...], seeds: Seeds) -> dict[int, set[int]]:
    """Subject -> places of its plain seeds."""
    if (out := seeds.voted.get(words)) is None:
        out = {}
        for i, w in enumerate(words):
            for term, places in ((w, (i,)), (f"{w} {words[i + 1]}" if i + 1 < len(words) else "", (i, i + 1))):
                for n, weight in seeds.of(term).items():
                    if weight == 2:
                        out.setdefault(n, set()).update(places)
        if len(seeds.voted) < 100_000:
            seeds.voted[words] = out
    return out


def evidence(beside: set[int], context: dict[int, float]) -> tuple[tuple[int, float], ...]:
    """Shares by subject that seeds in the same sentence and in the sentences around give."""
    own = OWN if beside and context else 1.0 if beside else 0.0
    return tuple((n, own * (n in beside) + (1 - own) * context.get(n, 0.0)) for n in sorted(beside | context.keys()))


def counted_terms(text: str, rated: list[int], seeds: Seeds, into: dict[str, dict[int, float]]) -> int:
    """Adds for each term of a text one (-1), and its share of evidence for each subject beside the term itself, on average over the
    sentences with it; so a document counts once for a term, however long it is. BASE is the average of all sentences. Returns the sentences."""
    total, here = 0, {}

    def seen(term: str, shares: tuple[tuple[int, float], ...]) -> None:
        if (before := here.get(term)) is None:
            here[term] = (1, shares)
        elif shares:
            both = dict(before[1])
            for n, x in shares:
                both[n] = both.get(n, 0.0) + x
            here[term] = (before[0] + 1, tuple(both.items()))

    for own in sections(text):
        split = [words_of(x) for x in own]
        hits = [seed_votes(w, seeds) for w in split]
        total += len(own)
        around = Counter(n for h in hits for n in h)
        for words, hit in zip(split, hits, strict=True):
            # Among the sentences around that have seeds, the share with those of a subject.
            others = {n: around[n] - (n in hit) for n in around}
            voiced = sum(others.values())
            context = {n: c / voiced for n, c in others.items() if c} if voiced else dict.fromkeys(rated, 1.0)
            if not context and not hit:
                continue
            usual, seeded = evidence(set(hit), context), set().union(*hit.values()) if hit else set()
            for term, first, last in terms_of(words):
                if first in seeded or last in seeded:
                    shares = evidence({n for n, places in hit.items() if not places <= {first, last}}, context)
                    if shares:
                        seen(term, shares)
                else:
                    seen(term, usual)
            seen(BASE, usual)
    for term, (count, shares) in here.items():
        if (at := into.get(term)) is None:
            at = into[term] = {-1: 0.0}
        at[-1] += 1.0
        for n, x in shares:
            at[n] = at.get(n, 0.0) + x / count
    return total


def _terms(subjects: list[tuple[str, str]]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds, into, total = Seeds(subjects), {}, 0

        def rows() -> pd.DataFrame:
            return pd.DataFrame([(t, n, float(c)) for t, own in into.items() for n, c in own.items()], columns=["term", "subject", "n"])

        for f in frames:
            for text, rated in zip(f["text"], f["rated"], strict=True):
                total += counted_terms(text, [] if rated is None else list(rated), seeds, into)
                if len(into) > 200_000:  # what was counted goes on; the sums are made behind
                    yield rows()
                    into = {}
        into[""] = {-1: float(total)}  # the sentences there are
        yield rows()

    return run


class Weights:
    """What the words of a sentence say on each subject, by the counts of all documents and the seeds as a prior."""

    def __init__(self, subjects: list[tuple[str, str]], counts: dict[str, dict[int, float]]):
        self.seeds, self.counts = Seeds(subjects), counts
        base = counts.get(BASE, {})
        self.least = {n: LIFT * base.get(n, 0.0) / max(1.0, base.get(-1, 0.0)) for n in range(len(subjects))}
        self.cache: dict[str, dict[int, float] | None] = {}
        self.voted: dict[str, tuple[dict[int, int], bool]] = {}

    def of(self, term: str) -> dict[int, float] | None:
        """Share by subject of a term; None if it is neither known nor a seed."""
        if term not in self.cache:
            own, seed = self.counts.get(term), self.seeds.of(term)
            if own is None and not seed:
                self.cache[term] = None
            else:
                own = own or {}
                n = own.get(-1, 0.0)
                share = {k: (own.get(k, 0.0) + SEED_WEIGHT * SEED_SHARE.get(seed.get(k, 0), 0.0)) / (n + SEED_WEIGHT) for k in {*own, *seed} - {-1}}
                self.cache[term] = {k: x for k, x in share.items() if k in seed or x >= self.least[k]}
        return self.cache[term]

    def beside(self, pair: str, word: dict[int, float]) -> dict[int, float]:
        """Share by subject of two words in a row; what one of them says alone is the prior."""
        own, seed = self.counts.get(pair, {}), self.seeds.of(pair)
        prior = {k: max(word.get(k, 0.0), SEED_SHARE.get(seed.get(k, 0), 0.0)) for k in {*word, *seed}}
        share = {k: (own.get(k, 0.0) + SEED_WEIGHT * prior.get(k, 0.0)) / (own.get(-1, 0.0) + SEED_WEIGHT) for k in {*own, *prior} - {-1}}
        return {k: x for k, x in share.items() if k in prior or x >= self.least[k]}

    def votes(self, sentence: str) -> tuple[dict[int, int], bool]:
        """({subject: 2 plain, 1 doubtful}, open) of a sentence. Two words in a row that are known speak for each of them."""
        if sentence in self.voted:
            return self.voted[sentence]
        words = words_of(sentence)
        alone = [self.of(w) for w in words]
        pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
        best: dict[int, float] = {}
        for i, own in enumerate(alone):
            beside = [p for p in pairs[max(0, i - 1) : i + 1] if p in self.counts or self.seeds.of(p)]
            for said in [self.beside(p, own or {}) for p in beside] or [own or {}]:
                for n, share in said.items():
                    best[n] = max(share, best.get(n, 0.0))
        plain = max(PLAIN, max(best.values(), default=0.0) - NEAR)
        out = {n: 2 if share >= plain else 1 for n, share in best.items() if share >= DOUBTFUL}
        if 2 in out.values():  # beside a plain vote for one subject, doubtful ones for others mean little
            out = {n: v for n, v in out.items() if v == 2}
        content = [own is None for w, own in zip(words, alone, strict=True) if len(w) > 3]
        result = out, sum(content) >= 2 and 2 * sum(content) >= len(content)
        if len(self.voted) < 200_000:
            self.voted[sentence] = result
        return result


def document_votes(text: str, weights: Weights) -> tuple[int, Counter, Counter]:
    """(sentences, {(subject, lexicon vote, section vote): sentences}, {(lexicon vote, section vote): sentences}).

    Lexicon votes are 0 general, 1 doubtful, 2 plain and 3 open. Section votes are 0 to 2, and 3 where no other sentence of the
    section has a plain vote for anything. The first counts are of the subjects that a section has votes for, the second of
    all its sentences as they are for the others; of these, (subject, lexicon vote, section vote + 10) takes back what the
    section adds to them for a subject that it has votes for.
    """
    total, counts, rest = 0, Counter(), Counter()
    for own in sections(text):
        cast = [weights.votes(s) for s in own]
        total += len(own)
        plain = Counter(n for v, _ in cast for n, w in v.items() if w == 2)
        voiced = sum(2 in v.values() for v, _ in cast)
        present = plain.keys() | {n for v, _ in cast for n in v}
        for v, unknown in cast:
            silent = 3 if unknown and not v else 0
            alone = voiced - (2 in v.values()) == 0
            rest[silent, 3 if alone else 0] += 1
            for n in present:
                w = v.get(n, 0)
                others = plain[n] - (w == 2)
                counts[n, w or silent, 3 if alone else 0 if not others else 1 if others / max(1, len(own) - 1) < 0.25 else 2] += 1
                counts[n, silent, 13 if alone else 10] += 1
    return total, counts, rest


def _voted(known: Broadcast):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = Weights(*known.value)
        for f in frames:
            rows = []
            for doc, text, repo, source in zip(f["doc"], f["text"], f["repo"], f["source"], strict=True):
                total, counts, rest = document_votes(text, weights)
                rows += [(doc, repo, source, total, -1, w, s, c) for (w, s), c in rest.items()]
                rows += [(doc, repo, source, total, n, w, s, c) for (n, w, s), c in counts.items()]
            yield pd.DataFrame(rows, columns=["doc", "repo", "source", "total", "subject", "lexicon", "section", "n"])

    return run


#: What the lexicon's votes are taken to be worth before anything is learned, where a subject is not dealt with and where it is, in
#: general, doubtful, plain and open sentences; and how often the sentences seen that counts.
PRIOR_TIMES = 10
#: Section, address and source lean on each other: the odds of k of them together are taken to the power of 1 + k to the minus LEANING.
#: No vote of theirs is held to be rarer than RAREST, either way.
LEANING, RAREST = 0.75, 0.02
#: The vote of a function, other than the lexicon, that has nothing to go by; it says nothing either way.
ABSTAINS = 3
LEXICON_PRIOR = ((0.93, 0.02, 0.001, 0.049), (0.04, 0.06, 0.85, 0.05))


def learn(patterns: dict[tuple[int, ...], float], levels: list[int], rounds: int = 60, prior_times: float = 0.0, leaning: float = 0.0) -> dict[tuple[int, ...], float]:
    """Posterior of each pattern of votes, by EM on a latent yes or no per sentence and subject, functions independent given it.

    ``patterns``: number of (sentence, subject) with these votes; the first vote is the lexicon's. Its rates have a prior that
    counts ``prior_times`` the sentences seen, so that the latent yes stays one on the sentence: the others lean on each other
    and would turn it into one on the section; for ``leaning`` see LEANING.
    """
    start = {0: 0.01, 1: 0.3, 2: 0.95, 3: 0.1}
    post = {p: start[p[0]] for p in patterns}
    total = sum(patterns.values()) or 1.0
    for _ in range(rounds):
        yes = sum(n * post[p] for p, n in patterns.items())
        prior = min(max(yes / total, 1e-6), 1 - 1e-6)
        table = []
        for j, size in enumerate(levels):
            own = [[0.5] * size, [0.5] * size]
            for p, n in patterns.items():
                if j == 0 or p[j] != ABSTAINS:
                    own[1][p[j]] += n * post[p]
                    own[0][p[j]] += n * (1 - post[p])
            if j == 0:
                own = [[x + prior_times * sum(side) * q for x, q in zip(side, prior_of[:size], strict=True)] for side, prior_of in zip(own, LEXICON_PRIOR, strict=True)]
            table.append([[math.log(max(x / sum(side), RAREST if j else 0.0)) for x in side] for side in own])
        fresh = {}
        for p in patterns:
            voting = [j for j, v in enumerate(p) if j and v != ABSTAINS]
            said = sum(table[j][1][p[j]] - table[j][0][p[j]] for j in voting) / (1 + len(voting)) ** leaning
            odds = math.log(prior / (1 - prior)) + table[0][1][p[0]] - table[0][0][p[0]] + said
            fresh[p] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
        if max(abs(fresh[p] - post[p]) for p in patterns) < 1e-6:
            return fresh
        post = fresh
    return post


def term_counts(rows: DataFrame, subjects: list[tuple[str, str]]) -> dict[str, dict[int, float]]:
    """{term: {-1: sentences, subject: evidence}} of the known terms, over all rows. Bounded by LEAST_SHARE."""
    counts = written(rows.mapInPandas(_terms(subjects), "term string, subject int, n double").groupBy("term", "subject").agg(F.sum("n").alias("n")))
    sentences = counts.where("term = ''").agg(F.sum("n")).first()[0] or 0.0
    enough = counts.where((F.col("term") == BASE) | (F.col("term") != "") & (F.col("subject") == -1) & (F.col("n") >= max(LEAST, LEAST_SHARE * sentences))).select("term")
    out: dict[str, dict[int, float]] = {}
    for r in counts.join(enough, "term", "left_semi").collect():
        out.setdefault(r[0], {})[r[1]] = r[2]
    return out


def _subjects(table: DataFrame | None) -> list[tuple[str, str]]:
    """Names and descriptions; bounded: the table has a row for each subject."""
    if table is None:
        return DEFAULT
    rows = table.where("subject is not null").groupBy("subject").agg(F.min("description").alias("d")).orderBy("subject").collect()
    return [(r[0], r[1] or "") for r in rows]


def subject_posteriors(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", repo: str = "repo", source: str = "source", subjects: DataFrame | None = None, labels: DataFrame | None = None,
) -> DataFrame:
    """(doc, subject, sentences, share, dealt): per document and subject the expected share of its sentences that deal with it, and
    the share of those that more likely do than not. For ``subjects`` and ``labels`` see ``assign_subjects``."""
    spark = df.sparkSession
    kind = dict(df.dtypes)[doc_id]
    known = _subjects(subjects)
    names = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(known)], "subject int, name string")
    rows = df.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(text).alias("text"), F.coalesce(F.col(repo), F.lit("")).alias("repo"), F.coalesce(F.col(source), F.lit("")).alias("source"))
    if labels is None or not known:
        rated = rows.withColumn("rated", F.lit(None).cast("array<int>"))
    else:
        sample = labels.where("doc_id is not null").join(F.broadcast(names), labels["subject"] == names["name"]).groupBy(F.col("doc_id").alias("doc")).agg(F.collect_set(names["subject"]).alias("rated"))
        rated = rows.join(F.broadcast(sample.orderBy(F.xxhash64("doc"), "doc").limit(RATED)), "doc", "left")
    counts = term_counts(rated.select("text", "rated"), known)
    shared = spark.sparkContext.broadcast((known, counts))
    voted = rows.mapInPandas(_voted(shared), f"doc {kind}, repo string, source string, total int, subject int, lexicon int, section int, n int").dropDuplicates(["doc", "subject", "lexicon", "section"])
    voted = written(voted)
    whole = voted.where("subject < 0")

    plain = voted.where("subject >= 0 and lexicon = 2 and section < 10")

    def hits(key: str) -> DataFrame:
        per = plain.groupBy(key, "subject").agg(F.sum("n").alias(f"{key}_hits"))
        return per.withColumn(f"{key}_all", F.sum(f"{key}_hits").over(Window.partitionBy(key)))  # one row for each subject and key

    def level(key: str) -> Column:
        """2 where the subject has a quarter of the plain votes of this key in other documents, 1 where a twentieth, else 0; 3 where there are hardly any, or no key."""
        others = F.col(f"{key}_all") - F.coalesce("own_all", F.lit(0))
        share = (F.coalesce(f"{key}_hits", F.lit(0)) - F.coalesce("own_hits", F.lit(0))) / others
        return F.when((F.col(key) == "") | F.coalesce(others < 5, F.lit(True)), 3).when(share >= 0.25, 2).when(share >= 0.05, 1).otherwise(0)

    by_repo, by_source = hits("repo"), hits("source")
    own = plain.groupBy("doc", "subject").agg(F.sum("n").alias("own_hits")).withColumn("own_all", F.sum("own_hits").over(Window.partitionBy("doc")))
    whole_of = [by.groupBy(key).agg(F.max(f"{key}_all").alias(f"{key}_all")) for key, by in (("repo", by_repo), ("source", by_source))]
    # Sentences of which neither words nor section speak for a subject, but the repository does.
    known_there = voted.where("subject >= 0 and section >= 10").select("doc", "subject", "lexicon", (F.col("section") - 10).alias("section"), F.col("n").alias("taken"))
    silent = whole.drop("subject").join(by_repo.where("repo_hits >= 0.05 * repo_all").select("repo", "subject"), "repo").join(known_there, ["doc", "subject", "lexicon", "section"], "left")
    silent = silent.select("doc", "repo", "source", "total", "subject", "lexicon", "section", (F.col("n") - F.coalesce("taken", F.lit(0))).cast("int").alias("n")).where("n > 0")
    cast = voted.where("subject >= 0 and section < 10").unionByName(silent)
    for key, by, whole_by in (("repo", by_repo, whole_of[0]), ("source", by_source, whole_of[1])):
        cast = cast.join(by.drop(f"{key}_all"), [key, "subject"], "left").join(whole_by, key, "left")
    cast = cast.join(own.select("doc", "subject", "own_hits"), ["doc", "subject"], "left").join(own.groupBy("doc").agg(F.max("own_all").alias("own_all")), "doc", "left")
    cast = cast.select("doc", "subject", "total", "lexicon", "section", level("repo").alias("address"), level("source").alias("origin"), "n")
    cast = written(cast)
    # Bounded: 4 levels of each of 4 functions.
    seen = cast.groupBy("lexicon", "section", "address", "origin").agg(F.sum("n").alias("n")).collect()
    pairs = (whole.agg(F.sum("n")).first()[0] or 0) * len(known)
    patterns = {(r[0], r[1], r[2], r[3]): float(r[4]) for r in seen}
    patterns[0, 0, 0, 0] = patterns.get((0, 0, 0, 0), 0.0) + max(0.0, pairs - sum(patterns.values()))
    post = learn(patterns, [4, 4, 4, 4], prior_times=PRIOR_TIMES, leaning=LEANING)
    table = spark.createDataFrame([(*k, v) for k, v in post.items()], "lexicon int, section int, address int, origin int, p double")
    dealt = cast.join(F.broadcast(table), ["lexicon", "section", "address", "origin"])
    share = dealt.groupBy("doc", "subject", "total").agg(F.sum(F.col("n") * F.col("p")).alias("expected"), F.sum(F.when(F.col("p") >= 0.5, F.col("n")).otherwise(0)).alias("likely"))
    return share.join(F.broadcast(names), "subject").select("doc", F.col("name").alias("subject"), F.col("total").alias("sentences"), (F.col("expected") / F.col("total")).alias("share"), (F.col("likely") / F.col("total")).alias("dealt"))


def assign_subjects(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", repo: str = "repo", source: str = "source", least: float = 0.25, subjects: DataFrame | None = None, labels: DataFrame | None = None,
) -> DataFrame:
    """(doc, subject): the subjects that at least ``least`` of a document's sentences deal with; none, one or more.

    ``subjects`` (subject, description): the subjects there are; one without a list of seeds begins with the words of its
    description. None: the ten of the list. ``labels`` (doc_id, subject): rated documents, of which RATED at most are read;
    their sentences count as evidence. Null ids and texts are left out; an empty text has no sentences and no subject; null
    repositories and sources are one unknown each; rows repeated under one id count once as documents. A text is read whole.
    An empty table gives an empty result. Other columns play no part.
    """
    return subject_posteriors(df, doc_id, text, repo, source, subjects, labels).where(F.col("dealt") >= least).select("doc", "subject")


def subject_shares(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", repo: str = "repo", source: str = "source", subjects: DataFrame | None = None, labels: DataFrame | None = None,
) -> DataFrame:
    """Per subject: documents that have it, and its share of all documents with text."""
    found = assign_subjects(df, doc_id, text, repo, source, subjects=subjects, labels=labels).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"))
    every = df.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).agg(F.countDistinct(doc_id).alias("all"))
    return found.join(F.broadcast(every)).select("subject", "documents", (F.col("documents") / F.col("all")).alias("share"))
