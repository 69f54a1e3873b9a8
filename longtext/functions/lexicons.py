"""Word lists, patterns and enumerations. Results depend on them being exactly these."""

# fmt: off
# Counters of vagueness, hedging and disfluency.
INDEFINITE_WORDS = (
    "thing", "things", "stuff", "something", "anything", "nothing", "everything",
    "someone", "somebody", "anyone", "anybody", "everyone", "everybody",
    "somewhere", "anywhere", "somehow", "whatever", "whatchamacallit",
)
HEDGE_WORDS = (
    "maybe", "perhaps", "possibly", "probably", "presumably", "somewhat",
    "roughly", "approximately", "apparently", "seemingly", "arguably",
    "guess", "suppose", "presume", "reckon", "likely", "unlikely",
)
HEDGE_PHRASES = (
    "sort of", "kind of", "i think", "i guess", "i mean", "you know", "more or less",
    "a little bit", "i suppose", "or something", "i believe",
)
FILLER_WORDS = ("uh", "um", "er", "ah", "hmm", "mm", "erm", "uhh", "umm")

# The published trajectory study's fillers and low-imageability verbs, and its word limit.
STUDY_FILLERS = ("well", "so", "basically", "actually", "literally", "um", "ah")
STUDY_VERBS = ("be", "have", "do", "get", "give", "go", "make", "come", "take", "put", "move", "turn", "bring", "keep")
STUDY_WORDS = 1400
# Its published coefficients (speaker, feature, r, p, n).
PUBLISHED = (
    ("reagan", "unique_words", -0.446, 0.002, 46),
    ("reagan", "ns_plus_fillers", 0.358, 0.017, 46),
    ("reagan", "li_verbs", 0.032, 0.835, 46),
    ("bush41", "unique_words", -0.098, 0.343, 101),
    ("bush41", "ns_plus_fillers", 0.053, 0.608, 101),
    ("bush41", "li_verbs", -0.099, 0.333, 101),
)

# Part-of-speech and dependency sets.
FUNCTION_POS = ("ADP", "AUX", "CCONJ", "DET", "PART", "PRON", "SCONJ")
CONTENT_POS = ("NOUN", "PROPN", "VERB", "ADJ", "ADV")
PROPOSITION_POS = ("VERB", "ADJ", "ADV", "ADP", "CCONJ", "SCONJ")
SUBORDINATE_DEPS = ("advcl", "ccomp", "xcomp", "acl", "relcl", "csubj", "csubjpass")
CLAUSE_DEPS = ("ROOT", "advcl", "ccomp", "xcomp", "acl", "relcl", "csubj", "csubjpass", "conj", "parataxis")

# Lines that are boilerplate alone, and markers that protect a line.
BOILERPLATE = (
    r"^\s*(home|menu|search|skip to (main )?content)\s*$",
    r"^\s*(share|tweet|print|email this)\s*$",
    r"^\s*(copyright|©|\(c\))\b.*$",
    r"^\s*all rights reserved.*$",
    r"^\s*(privacy policy|terms of (use|service)|cookie policy)\s*$",
    r"^\s*(advertisement|sponsored)\s*$",
    r"^\s*(related (articles|stories|content)|read more|next|previous)\s*$",
    r"^\s*citation:.*the american presidency project.*$",
)
PROTECTED = r"\[(applause|laughter|crosstalk|inaudible|cheers|booing|recording interrupted|the president)\b"

# Labels of turns.
QUESTION_LABEL = r"^\s*(Q[:.\s]|QUESTION[:.]|REPORTER[:.]|MODERATOR[:.])"
ANSWER_LABEL = r"^\s*(THE PRESIDENT|THE VICE PRESIDENT|PRESIDENT [A-Z]+)[:.]"
SPEAKER_LABEL = r"^\s*[A-Z][A-Z .'\-]{2,40}:"
TURN_ANSWER = r"^\s*(?:The President|THE PRESIDENT)\.\s*"
TURN_QUESTION = r"^\s*(?:Q\b[.:]?|QUESTION[.:]|REPORTER[.:]|MODERATOR[.:])"
TURN_OTHER = r"^\s*(?:The Vice President|The Secretary|Mr\.|Ms\.|Mrs\.|Senator|Governor|Q)\b"

# Event types by title, in order, and the hints of setting.
EVENT_RULES = (
    (r"\b(inaugural address|state of the union|farewell address|address to the nation|address before|joint session)\b", "formal_address"),
    (r"\b(campaign rally|rally|make america great)\b", "rally"),
    (r"\b(news conference|press conference|press briefing|briefing)\b", "press_conference"),
    (r"\b(interview|conversation with)\b", "interview"),
    (r"\b(presidential debate|debate)\b", "debate"),
    (r"\b(roundtable)\b", "roundtable"),
    (r"\b(town hall)\b", "town_hall"),
    (r"\b(radio address|weekly address|fireside)\b", "radio_address"),
    (r"\b(statement on signing|signing of|upon signing|signing statement)\b", "signing_statement"),
    (r"\b(question[- ]and[- ]answer|q\s*&\s*a|exchange with reporters)\b", "q_and_a"),
    (r"\b(remarks)\b", "remarks"),
)
EVENT_TYPES = (
    "formal_address", "rally", "press_conference", "interview", "debate", "remarks", "roundtable",
    "signing_statement", "radio_address", "town_hall", "q_and_a", "other",
)
PREPARED, SPOKEN, MIXED = ("formal_address", "radio_address", "signing_statement"), ("press_conference", "interview", "q_and_a", "debate", "town_hall"), ("rally", "remarks", "roundtable")
CAMPAIGN_HINTS = r"\b(rally|campaign|make america great|for president|vote for|on the campaign trail|caucus|primary night)\b"
OFFICIAL_HINTS = r"\b(white house|oval office|rose garden|cabinet room|east room|briefing room|air force one)\b"

# Speakers (key, name, names to match, in this order; collected from, to) and their neutral codes.
SPEAKERS = (
    ("reagan", "Ronald Reagan", ("Ronald Reagan", "Reagan"), "1981-01-20", "1989-01-20"),
    ("bush41", "George H. W. Bush", ("George Bush", "George H. W. Bush"), "1989-01-20", "1993-01-20"),
    ("clinton", "Bill Clinton", ("William J. Clinton", "Bill Clinton", "Clinton"), "1993-01-20", "2001-01-20"),
    ("bush43", "George W. Bush", ("George W. Bush",), "2001-01-20", "2009-01-20"),
    ("obama", "Barack Obama", ("Barack Obama", "Obama"), "2009-01-20", "2017-01-20"),
    ("trump", "Donald Trump", ("Donald J. Trump", "Donald Trump", "Trump"), "2015-06-15", "2026-12-31"),
    ("biden", "Joseph R. Biden", ("Joseph R. Biden", "Joe Biden", "Biden"), "2021-01-20", "2025-01-20"),
)
CODES = {"reagan": "K", "bush41": "M", "clinton": "N", "bush43": "H", "obama": "P", "biden": "L"}
SPLIT_KEY, SPLIT_CODES, SPLIT_DATE = "trump", ("S", "V"), "2021-01-20"
CODE_NAMES = {
    "K": "Reagan", "M": "G.H.W. Bush", "N": "Clinton", "H": "G.W. Bush",
    "P": "Obama", "L": "Biden", "S": "Trump (1st term)", "V": "Trump (2nd term)",
}

# Document paths that hold no transcript.
NOT_DOCUMENTS = ("app-categories", "presidential-documents-archive-guidebook", "category-attributes", "")
NOT_DOCUMENT_PATTERNS = (r"-event-timeline$", r"^digest-other-white-house-announcements")

# Where each archive's pages hold their parts, first hit first.
ARCHIVES = {
    "archive_1": {
        "title": ("div.field-ds-doc-title h1", "h1.title", "div.field-docs-title", "h1"),
        "date": ("span.date-display-single", "div.field-docs-start-date span", "div.field-docs-person-date span.date-display-single"),
        "content": ("div.field-docs-content", "div.field-ds-doc-content", "div.field-name-field-docs-content"),
        "location": ("div.field-spot-state", "div.field-docs-state"),
        "person": ("div.field-docs-person h3.diet-title a", "div.field-docs-person .field-title a", "div.field-docs-person h3 a", "div.field-docs-person a[href*='/people/']"),
    },
    "archive_2": {
        "title": ("h2.presidential-speeches--title", "h1.presidential-speeches--title", "h1.title", "h1"),
        "date": ("p.episode-date", "span.date-display-single", "time"),
        "content": ("div.transcript-inner", "div.view-transcript", "div.transcript", "div.field--name-field-transcript"),
        "location": (),
        "person": ("p.president-name", ".about-this-episode--inner .president-name"),
    },
    "archive_3": {
        "title": ("h1.page-title", "h1.entry-title", "h1", "title"),
        "date": ("time", "span.posted-on", "p.meta__date", "meta[property='article:published_time']"),
        "content": ("div.body-content", "div.entry-content", "article", "div.page-content"),
        "location": (),
        "person": (),
    },
}

# The published Paice/Husk rules (ending reversed, * intact only, letters to remove, letters to add, > go on, . stop).
LANCASTER_RULES = (
    "ai*2. a*1. bb1. city3s. ci2> cn1t> dd1. dei3y> deec2ss. dee1. de2> dooh4> e1> feil1v. fi2> gni3> gai3y. ga2> gg1. ht*2. "
    "hsiug5ct. hsi3> i*1. i1y> ji1d. juf1s. ju1d. jo1d. jeh1r. jrev1t. jsim2t. jn1d. j1s. lbaifi6. lbai4y. lba3> lbi3. lib2l> lc1. "
    "lufi4y. luf3> lu2. lai3> lau3> la2> ll1. mui3. mu*2. msi3> mm1. nois4j> noix4ct. noi3> nai3> na2> nee0. ne2> nn1. pihs4> pp1. "
    "re2> rae0. ra2. ro2> ru2> rr1. rt1> rei3y> sei3y> sis2. si2> ssen4> ss0. suo3> su*2. s*1> s0. tacilp4y. ta2> tnem4> tne3> tna3> "
    "tpir2b. tpro2b. tcud1. tpmus2. tpec2iv. tulo2v. tsis0. tsi3> tt1. uqi3. ugo1. vis3j> vie0. vi2> ylb1> yli3y> ylp0. yl2> ygo1. "
    "yhp1. ymo1. ypo1. yti3> yte3> ytl2. yrtsi5. yra3> yro3> yfi3. ycn2t> yca3> zi2> zy1s."
).split()

# Stop words of English full-text search that occur in queries and texts here.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()

#: Columns of the transcript metadata, in their order.
METADATA_FIELDS = (
    "id", "president", "date", "year", "title", "source", "source_url", "event_type", "location", "campaign_or_official",
    "prepared_or_impromptu", "has_q_and_a", "word_count", "char_count", "quality_score", "duplicate_cluster_id", "is_canonical",
    "raw_file_path", "clean_file_path", "notes", "sentence_count", "mean_sentence_length", "median_sentence_length", "paragraph_count",
    "type_token_ratio", "flesch_reading_ease", "flesch_kincaid_grade", "speaker_label_count", "question_count", "question_answer_ratio",
    "event_duration_seconds", "retrieval_date",
)
# fmt: on
