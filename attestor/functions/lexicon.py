"""Vocabularies of the verification rules."""

from __future__ import annotations

from attestor.functions.dialect import words_of

# Word lists, registries and patterns that the results depend on.

HINDI_STOPWORDS = words_of(
    "में पर से को का की के ने तक द्वारा हेतु प्रति है हैं था थी थे होगा होगी होंगे होना होने होता होती होते "
    "रहा रही रहे कर करके किया किए दिया दिए लिया लिए यह वह इस उस इन उन इसे उसे इन्हें उन्हें इसका उसका "
    "इनका उनका जिसका जिसके जिसकी कौन क्या किसे किसका किसने किसके कुछ कोई सब सभी और तथा एवं या अथवा भी तो "
    "ही लेकिन किन्तु परन्तु मगर क्योंकि चूंकि इसलिए यदि अगर जब तब जहां वहां जैसे वैसे कि अपने अपनी अपना वाले वाली वाला "
    "जा जाता जाती जाते गया गई गए हुए हुआ हुई"
)
QUERY_STOPWORDS = (
    words_of(
        "a an the and or but if while as at by for from in into of off on onto out over to up with is are was were be been being "
        "have has had do does did will would shall should can could may might must it its they them their this that these those "
        "there which who whom whose what where when how why said says according stated told announced also increased decreased "
        "held keeps reported confirmed revealed समाचार खबर रिपोर्ट अनुसार बारे"
    )
    + HINDI_STOPWORDS
)
CONCEPT_STOPWORDS = words_of(
    "the a an and or but in on at to for of with by from up about into over after is are was were be been being have has had do does "
    "did will would shall should may might must can could it its their they them that this these those which who whom whose what "
    "where when why how all any both each few more most other some such no nor not only own same so than too very s t just don now"
)
RELEVANCE_STOPWORDS = (
    QUERY_STOPWORDS
    + words_of(
        "study report survey nonprofit organization city near found said stated announced reported confirmed revealed percent year years "
        "day days official officials statement press release news update article source author"
    )
)

ABBREVIATIONS = words_of("mr mrs ms dr prof inc ltd co dept est vs no approx rs jan feb mar apr jun jul aug sep oct nov dec")
DOTTED_ABBREVIATIONS = words_of("e.g i.e u.s u.k u.n")

OPINIONS = words_of(
    "in my opinion|i think|i believe|i feel|we believe|in our view|personally|it seems to me|who knows|should be|ought to|what a shame|"
    "thankfully|unfortunately|luckily|amazingly|hopefully"
)
MONTHS = words_of("january february march april may june july august september october november december")
MONEY_WORDS = words_of("dollar dollars rupee rupees crore lakh billion million trillion percent")
REPORT_VERBS = words_of(
    "announced increased decreased approved reported confirmed signed passed launched stated declared discovered appointed decided published "
    "ordered ruled banned rejected"
)
INSTITUTIONS = words_of(
    "government ministry court bank president minister governor commission agency parliament senate department police spokesperson "
    "organization who un rbi nasa fda cdc sec isro"
)
HINDI_FACTS = words_of("प्रतिशत करोड़ लाख अरब घोषणा फैसला आदेश दावा पुष्टि बैन प्रतिबंध सरकार मंत्रालय अदालत पुलिस बैंक राष्ट्रपति मंत्री सेना")
CURRENCY = "$€£₹"

STARTERS = words_of(
    "the this that these those police government survey study report research analysis data findings officials sources nearly almost about "
    "according after before during several many most some all new recent"
)
GENERIC_NOUNS = words_of("survey study report analysis nonprofit")
TRIMMED = ".,;:\"'()?![]{}।॥"

BODY_NEGATIONS = words_of(
    "not|no|never|neither|nor|cannot|can't|didn't|did not|won't|will not|wasn't|was not|weren't|were not|hasn't|has not|haven't|have not|"
    "denied|rejected|failed to|ruled out|dismissed"
)
NEGATIONS = words_of(
    "not|no|never|neither|nor|cannot|can't|didn't|did not|won't|will not|wasn't|was not|weren't|were not|hasn't|has not|haven't|have not|"
    "isn't|is not|aren't|are not|denied|refused|failed to|rejected|dismissed|refuted|debunked|prevented"
)
HINDI_BODY_NEGATIONS = words_of("नहीं ना इनकार खारिज")
HINDI_NEGATIONS = words_of("नहीं ना इनकार खारिज गलत झूठ")

QUANTITY = (
    r"(?:nearly|approximately|about|over|around|up to)?\s*(?:[$€£₹]\s*)?\b\d+(?:\.\d+)?%?\b"
    r"(?:\s*(?:percent|crore|lakh|billion|million|trillion|students|people|officers|times a week|प्रतिशत|करोड़|लाख|अरब))?"
)
TIME = (
    r"\b(?:at\s+\d{1,2}(?::\d{2})?\s*(?:am|pm)?|in\s+(?:19\d\d|20\d\d)|on\s+(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)|"
    r"(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{1,2}(?:,\s*\d{4})?|\b(?:19\d\d|20\d\d)\b)\b"
)
PLACE = r"\b(?:in|at|near|across)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*(?:\s+city)?(?:\s+near\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)?)\b"
HINDI_PLACE = r"([\x{0900}-\x{097F}\w]{3,})\s+(?:में|के\s+पास)(?:\s|$)"
SAID = (
    r"^(?:according to ([^,\.;]+)|(?:a\s+)?(?:\d{4}\s+)?(?:study|report|survey)\s+by\s+([^,\.;]+,\s*[^,\.;]+|[^,\.;]+)|"
    r"([A-Z][A-Za-z0-9\s\.\-]+?)\s+(?:said|stated|reported|announced|claimed|confirmed|found))\s+(?:that\s+|,)?"
)
HINDI_SAID = r"^(?:([^,;।]+?)\s+के\s+अनुसार|([^,;।]+?)\s+ने\s+(?:बताया|कहा|दावा किया|पुष्टि की))\s*(?:कि|,)?"
CLAIM_ACTIONS = words_of(
    "detained arrested launched increased decreased approved rejected reported confirmed found announced ordered banned ruled beaten punished "
    "killed signed passed held kept used struck filed investigated"
)
HINDI_ACTIONS = words_of(
    "हमला घुसपैठ गिरफ्तार हिरासत घोषणा दावा खारिज पुष्टि प्रतिबंध आदेश फैसला शुरू हस्ताक्षर दर्ज जांच मंजूरी रद्द हताहत मौत बताया कहा"
)
PREDICATE_VERBS = words_of(
    "detained arrested used launched increased decreased approved rejected reported found announced ordered banned ruled beaten fired struck"
)
QUERY_ACTIONS = words_of(
    "detained arrested launched increased decreased approved rejected reported confirmed found announced ordered banned ruled beaten punished "
    "killed signed passed held kept used repo satellite"
)
SYNONYMS = [
    ("reserve bank of india", "RBI"), ("federal reserve", "Fed"), ("world health organization", "WHO"), ("united nations", "UN"),
    ("supreme court of india", "Supreme Court"), ("national aeronautics and space administration", "NASA"),
    ("indian space research organisation", "ISRO"), ("indian space research organization", "ISRO"),
    ("securities and exchange board of india", "SEBI"),
]

GOVERNMENT = words_of("gov gov.in nic.in pib.gov.in gov.uk whitehouse.gov state.gov treasury.gov parliament.uk sansad.in india.gov.in")
INSTITUTIONAL = words_of(
    "rbi.org.in who.int un.org nasa.gov isro.gov.in worldbank.org imf.org sec.gov cdc.gov nih.gov wto.org wmo.int iso.org edu ac.in ac.uk"
)
NEWS = words_of(
    "reuters.com apnews.com bbc.com bbc.co.uk thehindu.com indianexpress.com bloomberg.com wsj.com nytimes.com ft.com economist.com afp.com "
    "theguardian.com hindustantimes.com timesofindia.indiatimes.com nature.com sciencemag.org aljazeera.com dw.com france24.com"
)
ACADEMIC = words_of(
    "edu ac.in ac.uk nature.com sciencemag.org sciencedirect.com ncbi.nlm.nih.gov pubmed.ncbi.nlm.nih.gov thelancet.com nejm.org ieee.org "
    "arxiv.org springer.com jstor.org"
)
DICTIONARIES = words_of(
    "wiktionary.org dictionary.cambridge.org merriam-webster.com shabdkosh.com lexico.com collinsdictionary.com thefreedictionary.com "
    "urbandictionary.com wordsmith.org hindidictionary.org oxfordlearnersdictionaries.com vocabulary.com macmillandictionary.com"
)
DICTIONARY_PATHS = words_of("/wiki/wiktionary: /dictionary/ /definition/ /meaning-in- /meaning/ /grammar/ /alphabet/ /varnamala/ /words/")
CATEGORY_PATHS = words_of("/category/ /tag/ /topics/ /archive/ /search/")
DIRECTORIES = words_of("directory search-portal yellowpages find-a-lawyer -directory-")
LINGUISTIC_CLAIMS = words_of("dictionary|grammar|alphabet|word origin|शब्दावली|व्याकरण|वर्णमाला|सूत")
LINGUISTIC_MARKS = words_of(
    "वर्णमाला का|व्यंजन वर्ण|स्वर वर्ण|is the letter of the alphabet|definition and meaning|meaning in hindi|pronunciation and definition|"
    "शब्द का अर्थ|व्याकरण में|प्रत्याहार सूत्र|माहेश्वर सूत्र|synonyms and antonyms|part of speech|noun, plural"
)
AGENCY_SITES = words_of("reuters.com apnews.com ptinews.com aninews.in")
WIRES = [
    ("PTI (Press Trust of India)", r"\b(?:pti|press\s+trust\s+of\s+india)\b"),
    ("ANI (Asian News International)", r"\b(?:ani|asian\s+news\s+international)\b"),
    ("Reuters Wire", r"\b(?:reuters(?:\s+wire|\s+news\s+service)?)\b"),
    ("Associated Press (AP) Wire", r"\b(?:associated\s+press|ap\s+wire|ap\s+news)\b"),
    ("AFP (Agence France-Presse)", r"\b(?:afp|agence\s+france[\s\-]presse)\b"),
    ("IANS (Indo-Asian News Service)", r"\b(?:ians|indo[\s\-]asian\s+news\s+service)\b"),
    ("Syndicated News Feed", r"\b(?:syndicated\s+feed|news\s+agency\s+feed|syndicated\s+from)\b"),
]
OPINION_PATH = r"/(?:opinion|editorial|columns?|blogs?|commentary|viewpoint|analysis/opinion|voices?|perspectives?)/"
OPINION_TITLE = (
    r"^\s*(?:(?:opinion|editorial|column|comment|viewpoint|guest\s+column)\s*[:\-–—|]|analysis\s*[:\-–—|]\s*why|why\s+(?:we|i|you)\s+should|"
    r"here'?s?\s+why\s+i\s+think|letter\s+to\s+(?:the\s+)?editor)"
)
SHOUTS = words_of("SHOCKING|UNBELIEVABLE|SCANDAL|BOMBSHELL|MASSIVE|CRAZY|EXPOSED|MUST SEE|WATCH")
BAIT = r"\b(?:you\s+won'?t\s+believe|what\s+happened\s+next|blows\s+your\s+mind|doctors\s+hate\s+(?:this|him|her)|this\s+one\s+trick)\b"
NAMED_SOURCES = [
    (r"\b(?:according to|reported by|quoted|citing)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\b", 1, False),
    (r"\b([A-Z][a-z]+\s+[A-Z][a-z]+)\s+(?:said|stated|told|alleged|confirmed|argued|denied|warned)\b", 1, False),
    (r"\b(?:police commissioner|spokesperson|deputy commissioner|officials?|director general|ministry of [A-Za-z]+|supreme court bench)\b", 0, True),
]
NUMBER = r"(?:\$|€|£|₹)?\b\d+(?:\.\d+)?%?"
CLOCK = r"\b\d{1,2}(?::|\.)\d{2}\s*(?:am|pm)?\b"
LEGAL = r"\b(?:section\s+\d+|bnss|crpc|ipc|act|order)\b"
QUOTE = r"[\"“][^\"”]{5,}[\"”]"

DIRECTIONS = {
    "INCREASE": words_of("increase increased increasing raise raised raising hike hiked hiking elevated rose risen grew surged jumped up बढ़ा वृद्धि इजाफा तेजी बढ़ोतरी"),
    "DECREASE": words_of("decrease decreased decreasing cut cutting slash slashed slashing reduce reduced reducing lowered fell dropped slumped down घटा गिरावट कमी कटौती"),
    "UNCHANGED": words_of("unchanged steady hold held pause paused maintained flat stagnant keep kept retained"),
    "APPROVE": words_of(
        "approve approved approving pass passed passing sanction sanctioned ratified authorized cleared greenlighted adopted adopt adopting "
        "operationalized operationalize मंजूरी स्वीकार अनुमोदन"
    ),
    "REJECT": words_of("reject rejected rejecting deny denied ban banned veto vetoed dismissed blocked खारिज अस्वीकार रद्द इनकार प्रतिबंध"),
    "LAUNCH": words_of(
        "launch launched launching start started initiate initiated unveil unveiled introduced announced kicked kicks commenced commence "
        "शुरू प्रक्षेपण लॉन्च उद्घाटन"
    ),
    "DELAY": words_of("delay delayed delaying postpone postponed cancel cancelled halt halted suspended"),
    "WIN": words_of("win won winning triumph triumphed victorious beat beats beating defeat defeated defeating जीत जीता"),
    "LOSE": words_of("lose lost losing defeat defeated concede conceded fail failed eliminated beaten हार हारा"),
    "ARREST": words_of("arrest arrested arresting detain detained detaining nabbed apprehended jailed custody गिरफ्तार हिरासत कैद"),
    "FREE": words_of("release released releasing free freed acquitted cleared discharged exonerated bailed रिहा बरी"),
    "JOIN": words_of("join joined joining accede acceded accession member admitted enter entered शामिल"),
    "ISSUE": words_of("issue issued issuing publish published publishing notify notified bulletin release released जारी"),
    "DISCOVER": words_of("discover discovered discovering find found observe observed detect detected खोज पता"),
    "SIGN": words_of("sign signed signing ink inked conclude concluded finalize finalized हस्ताक्षर"),
}
#: Each direction's opposites.
OPPOSITES = {
    "INCREASE": ["DECREASE", "UNCHANGED"], "DECREASE": ["INCREASE", "UNCHANGED"], "UNCHANGED": ["INCREASE", "DECREASE"],
    "APPROVE": ["REJECT"], "REJECT": ["APPROVE"], "LAUNCH": ["DELAY"], "DELAY": ["LAUNCH"],
    "WIN": ["LOSE"], "LOSE": ["WIN"], "ARREST": ["FREE"], "FREE": ["ARREST"],
}
#: Groups of action words with one meaning; those for stance have the Hindi words after the bar as well.
_GROUPS = [
    ("start started starting launch launched launching initiate initiated initiating commenced commence kicked kicks", "शुरू"),
    ("approve approved approving pass passed passing adopt adopted adopting ratify ratified authorize authorized operationalize operationalized", "मंजूरी"),
    ("join joined joining accede acceded accession enter entered member admitted", "शामिल"),
    ("issue issued issuing publish published publishing release released releasing notify notified", "जारी"),
    ("arrest arrested arresting detain detained detaining apprehend apprehended custody", "गिरफ्तार हिरासत"),
    ("sign signed signing ink inked conclude concluded finalize finalized", "हस्ताक्षर"),
    ("find found finding observe observed observing discover discovered discovering detect detected detecting", ""),
    ("increase increased increasing raise raised raising hike hiked rose risen grew surged jumped", "वृद्धि"),
    ("decrease decreased decreasing cut cutting slash slashed reduce reduced lowered fell dropped slumped", "कमी"),
    ("hold held holding meet met meeting convene convened gather gathered", ""),
]
STANCE_GROUPS = [words_of(f"{english} {hindi}") for english, hindi in _GROUPS] + [
    words_of("ban banned banning prohibit prohibited prohibiting restrict restricted bar barred प्रतिबंध")
]
RELEVANCE_GROUPS = [words_of(english) for english, _ in _GROUPS] + [
    words_of("lathi baton batons caning dispersed disperse dispersing"),
    words_of("protest protests protester protesters protestor protestors march marching rally demonstration demonstrators agitation"),
]
REFUTATIONS = words_of(
    "entirely false|not true|denied reports|dismissed reports|fake claim|false claim|misleading reports|denies reports|rejected claim|no truth|"
    "untrue|debunked|fabricated|hoax|fact check finds false|refuted claims|unfounded|no evidence of|baseless|categorically denied|"
    "झूठा दावा|भ्रामक दावा|खंडन किया|गलत दावा|खारिज किया|फेक न्यूज|इनकार किया"
)
METRIC_TOPICS = words_of(
    "gdp growth inflation rate unemployment revenue profit deficit efficacy mortality poverty tax cases deaths toll score temperature poll "
    "votes share budget"
)
ALIASES = {
    "rbi": words_of("rbi|reserve bank|reserve bank of india"),
    "reserve bank of india": words_of("rbi|reserve bank|reserve bank of india"),
    "reserve bank": words_of("rbi|reserve bank of india"),
    "nasa": words_of("nasa|national aeronautics|national aeronautics and space administration"),
    "national aeronautics and space administration": words_of("nasa|national aeronautics"),
    "who": words_of("who|world health organization"),
    "world health organization": ["who"],
    "un": words_of("un|united nations"),
    "united nations": ["un"],
    "isro": words_of("isro|indian space research|indian space research organisation|indian space research organization"),
    "indian space research organisation": words_of("isro|indian space research"),
    "imf": words_of("imf|international monetary fund"),
    "international monetary fund": ["imf"],
    "sebi": words_of("sebi|securities and exchange board"),
    "bjp": words_of("bjp|bharatiya janata party"),
    "inc": words_of("congress|indian national congress"),
    "finmin": words_of("finmin|finance ministry|ministry of finance"),
    "ministry of finance": words_of("finmin|finance ministry|ministry of finance"),
    "finance ministry": words_of("finmin|finance ministry|ministry of finance"),
}
SUBJECT_NOISE = words_of(
    "bank court government ministry board commission department authority council organization agency percent basis point points rate rates "
    "year years crore lakh dollar"
)
BROAD_INSTITUTIONS = words_of(
    "who|un|united nations|world health organization|world bank|supreme court|high court|police|government|ministry|federal reserve|"
    "parliament|congress|senate|nasa|isro"
)
EXPLAINERS = words_of("explainer guide governance history operates structure overview")
OFFICIAL_ACTIONS = words_of(
    "ordered banned approved rejected arrested sentenced convicted acquitted launched signed ratified enacted repealed impeached indicted "
    "declared recalled sanctioned fined suspended"
)
GENERAL_ACTIONS = words_of("announced increased decreased reported confirmed court ministry agency bank government parliament police")
QUALITY = {
    "PRIMARY_OFFICIAL": 90, "ACADEMIC_RESEARCH": 88, "FACTUAL_REPORTING": 75, "SYNDICATED_WIRE": 70, "GENERAL_WEB": 50,
    "OPINION_EDITORIAL": 35, "SENSATIONAL_CLICKBAIT": 20,
}
