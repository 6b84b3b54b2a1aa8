"""Template residue, filler, error pages and script notices (problem 10).

One automaton holds all phrases and words of all languages and the signs that open a placeholder.
A text is read whole, block by block (a block is a line, wrapped ones together; a text of one line is one block). A block is
residue when what it says is a message, that is, when it holds a telling phrase, or words for a failure and for a thing
that fails, or for scripts and for switching them on, or for filling in and for what is to be filled in, and when the
matches cover most of its content. Function words of the languages count neither way, so a block
that talks about messages in more words than they have is none. Unfilled
placeholders and filler passages count wherever they stand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from http import HTTPStatus

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.functions.analyzer import STOPWORDS

# What messages say, in lower case; see also http.HTTPStatus for the names of errors.
#: By itself.
TELLING = {
    "error": """
        temporarily unavailable|access denied|permission denied|you do not have permission|you don't have permission|you are not authorized|not authorised|no longer available|has been removed|has been deleted|has been moved|page has moved|
        something went wrong|something failed|gave up|try again later|session expired|session has expired|log in again|please log in|sign in to continue|checking that you are human|checking your browser|verify that you are human|verify you are human|are you a robot|
        you are not redirected|if you are not redirected|most recent call last|traceback|stack trace|syntax error|parse error|fatal error|unhandled exception|segmentation fault|null pointer|keyerror|connection failed|connection refused|connection reset|connection timed out|
        too many connections|rate limit exceeded|quota exceeded|contact the administrator|oops|having trouble|
        zugriff verweigert|keine berechtigung|sitzung abgelaufen|bitte melden sie sich an|wartungsarbeiten|accès refusé|accès interdit|session expirée|veuillez vous connecter|introuvable|en maintenance|
        acceso denegado|acceso prohibido|sesión caducada|inicie sesión|en mantenimiento|algo salió mal|etwas ist schiefgelaufen|une erreur est survenue|ein fehler ist aufgetreten|se ha producido un error""",
    "stand-in": """
        goes here|text here|content here|click to edit|to edit this|sample page|sample heading|sample text|dummy text|to follow|to come|coming soon|under construction|your text|
        hier steht|text folgt|inhalt folgt|platzhalter|texte à venir|contenu à venir|votre texte ici|texto aquí|contenido aquí|próximamente""",
}
#: One of the first and one of the second together.
PAIRED = {
    "error": ("""
        error|errors|fehler|erreur|fail|failed|fails|failure|denied|refused|forbidden|unauthorized|unavailable|invalid|expired|missing|unable|cannot|can't|couldn't|unexpected|timeout|time-out|timed out|crashed|blocked|exception|broken|gone|
        not found|could not|not be|not available|not exist|doesn't exist|not permitted|not allowed|not authorized|not load|not loaded|not displayed|no longer|not responding|
        nicht|ungültig|abgelaufen|verweigert|gesperrt|fehlgeschlagen|indisponible|impossible|n'existe|pas disponible|plus disponible|pas pu|refusé|interdit|échec|expirée|
        no se|no existe|no está|no disponible|ya no|denegado|prohibido|falló|inválido|caducada|encontró|encontrada""",
              """
        page|pages|file|resource|url|address|link|document|record|server|servers|gateway|proxy|upstream|host|request|database|connection|session|website|site|portal|application|content|access|publication|ticket|
        seite|datei|ressource|adresse|dokument|server|anfrage|datenbank|verbindung|sitzung|zugriff|inhalt|veröffentlichung|dienst|page|fichier|ressource|serveur|requête|connexion|contenu|service|publication|accès|
        página|archivo|recurso|dirección|documento|servidor|solicitud|conexión|sesión|contenido|sitio|servicio|publicación|acceso"""),
    "script": ("""
        javascript|java script|js|scripts|scripting|cookies|skripte|skripten|los scripts|les scripts|des scripts""",
               """
        enable|enabled|activate|allow|turn on|turned on|switch on|switched off|turned off|disabled|required|requires|require|needs|need|must|blocked|works only|without|
        aktivieren|aktivieren sie|einschalten|schalten|erlauben|benötigt|erforderlich|zulassen|deaktiviert|activer|activez|autoriser|autorisez|nécessite|requis|désactivé|debe|habilitar|habilite|active|activar|permitir|permita|requiere|necesita|desactivado"""),
    "stand-in": ("""
        insert|add|enter|replace|write|type|put|fill in|paste|todo|tbd|tbc|fixme|einfügen|eingeben|ergänzen|ersetzen|insérer|saisir|ajouter|remplacer|insertar|escribir|introducir|añadir|reemplazar""",
                 """
        here|own words|your own|placeholder|summary|abstract|title|text|heading|caption|paragraph|description|content|name|section|tbd|todo|to follow|hier|zusammenfassung|überschrift|absatz|ici|résumé|titre|paragraphe|aquí|resumen|título|párrafo"""),
}
#: What else messages are made of.
AID = """
        sorry|please|leider|bitte|désolé|merci|veuillez|lo sentimos|por favor|reference|referencia|référence|vorgang|id|ray|code|number|error code|status|http|line|view|
        requested|requesting|looking|found|find|open|opening|opened|load|loading|loaded|display|displayed|view|see|show|retrieve|reach|reached|exist|exists|moved|removed|available|building|processing|process|occurred|sent|reply|response|returned|received|encountered|
        try|again|retry|reload|reloaded|refresh|continue|continue using|using|use|go on|go back|back|return|home|homepage|sitemap|login|log in|sign in|click|redirected|seconds|second|minutes|minute|hours|later|moment|wait|support|administrator|webmaster|contact|help|
        browser|settings|order|work|works|properly|correctly|run|then|human|opening|first|maintenance|temporarily|permission|authorized|paragraph|edit|sample|
        angeforderte|gefunden|geladen|werden|existiert|verfügbar|laden|nutzen|anzuzeigen|anzeigen|browser|einstellungen|später|erneut|versuchen|fortfahren|konnte|interner|serverfehler|nutzung|website|
        demandée|demandé|trouvée|trouvé|chargée|chargé|affichée|affiché|supprimée|supprimé|déplacée|déplacé|charger|afficher|voir|utiliser|navigateur|paramètres|continuer|réessayer|tard|site|existe|interne|
        solicitada|solicitado|cargar|encontrada|encontrado|disponible|navegador|ajustes|continuar|inténtelo|intente|nuevo|tarde|ver|interno|existe|código|este sitio"""
#: Words that say what they are only beside a status number of 400 to 599.
STATUS = "error http status gone fehler erreur código code"
# Function words of German, French and Spanish; English ones are the analyzer's.
FUNCTION = """der die das ein eine einen einem einer des den dem und oder in im ist sind war von zu zum zur mit auf für um sie ihr ihre ihrem ihren wir es hat haben kann an als bei aus diese dieser dieses diesen
le la les un une des du de d l et ou à au aux est sont était dans sur pour par avec ce cette ces votre vos notre nous vous il elle a ont que qui se s y en pas ne n
el los las uno una unos unas del y o al es son era esta este estos en con para por su sus nuestro usted que lo se ha han the we us our may""".split()
#: Fixed value: words of filler text.
FILLER = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
_NAME = r"[A-Za-z][A-Za-z0-9]*(?:[ _.\-][A-Za-z0-9]+)*"
#: Placeholders by the sign that opens them; each pattern is tried where the automaton finds the sign. A bare name in single braces must be longer than a letter, as {x} is plain notation.
PLACEHOLDERS = {
    "{{": rf"\{{\{{[-#/^>&]?\s*{_NAME}(?:\s*\|[^{{}}\n]{{1,80}})?\s*-?\}}\}}", "{%": rf"\{{%-?\s*{_NAME}[^{{}}%\n]{{0,80}}-?%\}}", "<%": rf"<%[=\-]?\s*{_NAME}\s*-?%>", "${": rf"\$\{{\s*{_NAME}\s*\}}", "#{": rf"#\{{\s*{_NAME}\s*\}}",
    "<<": rf"<<\s*{_NAME}\s*>>", "@@": rf"@@{_NAME}@@", "%%": rf"%%{_NAME}%%", "__": rf"__{_NAME}__", "[[": r"\[\[\s*[a-z]+(?:[_.][a-z0-9]+)*\s*\]\]", "{": r"\{[a-z][a-z0-9]+(?:[_.][a-z0-9]+)*\}",
    "[insert ": r"\[insert [^\[\]\n]{1,80}\]", "[your ": r"\[your [^\[\]\n]{1,80}\]", "[enter ": r"\[enter [^\[\]\n]{1,80}\]", "[add ": r"\[add [^\[\]\n]{1,80} here\]", "xxx_": r"xxx_[a-z0-9_.\- ]+?_xxx",
}
_OPEN = {k: re.compile(v, re.I) for k, v in PLACEHOLDERS.items()}
#: A line that goes on in lower case or as a quotation belongs to the block before it.
_BLOCK = re.compile(r"\s*\n\s*\n\s*|\s*\n(?!\s*(?:[a-zà-öø-ÿ]{2}|>))")
_STATUS_NUMBER = re.compile(r"\b[45]\d\d\b")
_WORD = re.compile(r"[^\W\d_]+")
_LATIN = re.compile(r"(?:us|um|is|it|ur|at|ae|em|am|ibus|que|unt|ent|ant|nt|os|or|ex|ac|et|eu|id|ut|ad|sed|non|vel|nec|quis|dui|mi|sem|nibh|leo|erat|urna|orci|odio)$")
_FILLER = frozenset(FILLER.split())
#: Filler words that are no words of the languages here; a passage counts as filler by these.
_FOREIGN = _FILLER - set("ad et non in id est do sit ut ex ea eu sed qui sint esse nulla minim tempor quis labore culpa anim".split())


def _phrases(text: str) -> list[str]:
    return [p.strip() for p in text.replace("\n", " ").split("|") if p.strip()]


_FUNCTION = frozenset(FUNCTION) | frozenset(STOPWORDS)


class Detector:
    """The automaton and the verdict on one text."""

    def __init__(self, coverage: float = 0.7, filler_words: int = 4) -> None:
        self.coverage, self.filler_words = coverage, filler_words
        known: dict[str, set[tuple[str, int]]] = {}

        def add(text: str, kind: str, side: int) -> None:
            for p in _phrases(text):
                known.setdefault(p, set()).add((kind, side))

        for kind, text in TELLING.items():
            add(text, kind, 0)
        add("|".join(s.phrase for s in HTTPStatus if s >= 400 and " " in s.phrase).lower(), "error", 0)
        for kind, sides in PAIRED.items():
            for side, text in enumerate(sides, 1):
                add(text, kind, side)
        add(AID, "", 0)
        add("|".join([*STATUS.split(), *(s.phrase.lower() for s in HTTPStatus if s >= 400 and s.phrase.isalpha())]), "status", 0)
        self.automaton, self.aid = ahocorasick.Automaton(), frozenset({("", 0)})
        for p, roles in known.items():
            self.automaton.add_word(p, ("phrase", p, self.aid if roles == self.aid else frozenset(roles)))
        for sign in PLACEHOLDERS:
            self.automaton.add_word(sign, ("sign", sign, frozenset()))
        self.automaton.make_automaton()

    def kind(self, text: str | None) -> str | None:
        """'placeholder', 'filler', 'error', 'script' or 'stand-in' for the first residue found, else None."""
        if not text or not text.strip():
            return None
        lowered = text.lower()
        low = lowered if len(lowered) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        spans: list[tuple[int, int, frozenset]] = []
        for end, (what, p, roles) in self.automaton.iter(low):
            start, stop = end + 1 - len(p), end + 1
            if what == "sign":
                if _OPEN[p].match(text, start):
                    return "placeholder"
            elif not (start and low[start - 1].isalpha()) and not (stop < len(low) and low[stop].isalpha()):
                spans.append((start, stop, roles))
        spans.sort(key=lambda x: x[0])
        at = k = 0
        for a, b in [m.span() for m in _BLOCK.finditer(text)] + [(len(low), len(low))]:
            first = k
            while k < len(spans) and spans[k][0] < a:
                k += 1
            if found := self._message(low, at, a, spans[first:k]) or self._filler(low[at:a]):
                return found
            at = b
        return None

    def _message(self, low: str, a: int, b: int, spans: list[tuple[int, int, frozenset]]) -> str | None:
        if not any(rs is not self.aid for _, _, rs in spans):
            return None
        roles = {r for _, _, rs in spans for r in rs}
        kinds = [kind for kind in ("script", "stand-in", "error") if (kind, 0) in roles or (kind, 1) in roles and (kind, 2) in roles and any((kind, 1) in x and (kind, 2) in y for _, _, x in spans for _, _, y in spans if x is not y)]
        if ("status", 0) in roles and "error" not in kinds and _STATUS_NUMBER.search(low, a, b):
            kinds.append("error")
        if not kinds:
            return None
        content = covered = k = upto = 0
        for m in _WORD.finditer(low, a, b):
            while k < len(spans) and spans[k][0] <= m.start():
                upto = max(upto, spans[k][1])
                k += 1
            if m[0] not in _FUNCTION:
                content += m.end() - m.start()
                covered += m.end() - m.start() if m.end() <= upto else 0
        return kinds[0] if content and covered >= self.coverage * content else None

    def _filler(self, block: str) -> str | None:
        """A passage of filler words, or of words that end as Latin ones do without any function word of the languages."""
        if not any(w in block for w in _HINTS):
            words = None
        else:
            words = _WORD.findall(block)
            at = [i for i, w in enumerate(words) if w in _FOREIGN]
            for i in sorted({max(0, min(k, len(words) - 8)) for k in at}) if len(at) >= self.filler_words else ():
                part = words[i:i + 8]
                if sum(w in _FOREIGN for w in part) >= self.filler_words and sum(w in _FILLER for w in part) >= 0.6 * len(part):
                    return "filler"
        if _LATINATE.search(block):
            words = words or _WORD.findall(block)
            if len(words) >= 8 and sum(bool(_LATIN.search(w)) or w in _FILLER for w in words) >= 0.8 * len(words) and not any(w in _FUNCTION and w not in _FILLER and not _LATIN.search(w) for w in words):
                return "filler"
        return None


#: Some of these stand in any passage of filler.
_HINTS = ("ipsum", "dolor", "amet", "consect", "adipis", "eiusmod", "tempor", "incidid", "labore", "aliqu", "nostrud", "exercit", "ullamco", "commodo", "consequat", "irure", "reprehen", "volupt", "cillum", "fugiat", "pariatur", "excepteur", "occaecat", "cupidat", "proident", "officia", "deserunt", "mollit", "laborum")
#: Three words in a row that end in us, um or is: no sentence of the languages goes without this sign of Latin and with it for long.
_LATINATE = re.compile(r"[a-z]{3,}(?:us|um|is|it|ur|ibus),? [a-z]{2,}(?:us|um|is|it|ur|ibus|et|ac|ae|am|em|or|os)\b")


def find_residue(documents: DataFrame, coverage: float = 0.7, filler_words: int = 4, key: str = "doc_id") -> DataFrame:
    """``(doc_id, kind)``: one row per document that holds residue, with the kind found first.

    A narrow pass over whole texts without any exchange. Null and empty texts hold no residue; repeated
    ids come out as often as they hold residue. ``coverage``: the part of a block's content that matches
    must cover; ``filler_words``: how many filler words that are no words of a language here make filler.
    """
    docs = documents.select(F.col(key).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = Detector(coverage, filler_words)
        for batch in batches:
            kinds = [detector.kind(t) for t in batch["text"].to_pylist()]
            out = pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "kind": pa.array(kinds, pa.string())})
            yield out.filter(out["kind"].is_valid())

    return docs.mapInArrow(scan, "doc_id long, kind string")


def without_residue(documents: DataFrame, coverage: float = 0.7, filler_words: int = 4, key: str = "doc_id") -> DataFrame:
    """The documents that hold no residue, all columns. The ids found are shuffled, not the texts of the scan."""
    found = find_residue(documents, coverage, filler_words, key).select(F.col("doc_id").alias(key)).distinct()
    return documents.join(found, key, "left_anti")
