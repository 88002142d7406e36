"""Word lists that results depend on."""

from __future__ import annotations

# English stop words.
ENGLISH_STOPWORDS = """
a an the and or but in on at to for
of with by from is was are were be been
being have has had do does did will would
could should may might shall can not no nor
so yet both either neither this that these
those i me my we our you your he she
it its they them their what which who whom
how when where why all any each few more
most other some such than then too very just
also about as if up out into over after
before between through during still now even
back only here there while because since until
although though however therefore thus hence well
re s t don doesn didn won hasn hadn
isn aren wasn weren ain via amp get got
let say said like know make made go going
one two three four five use used need want
""".split()

# Filipino stop words.
FILIPINO_STOPWORDS = """
ako ikaw ka siya kami tayo kayo sila
ko mo niya namin natin ninyo nila
akin iyo kanya atin inyo kanila
ang ng na sa ni kay nang kung dahil
para pero at o kasi kaya din rin pa
po nga naman lang lamang man raw daw
ba yata pala talaga halos mula hanggang
dito doon diyan ito iyon iyan yon yun
saan kailan sino ano paano bakit
may mayroon wala walang hindi huwag
oo opo ayaw gusto ibig
yan yung yong nung noong noon
lahat bawat ilang ibang iba
kanyang nito niyon
mga eh ah oh ha ay si
sya diba dapat
kapag habang gayun ganon ganyan
mismo sana siguro pwede puwede
""".split()

# Frequent words of the topic that say nothing about it.
TOPIC_NOISE = """
flood control dpwh flooding project projects
rt http https co t
department public works highways blue ribbon
senate committee budget president official
office congress house government administration
people time year years money
new big good bad great many much
city district secretary commission independent
sen his rep gov pnp nyo mag
corrupt
kaban bayan ibalik lng tlga naman kasi kahit
asawang 1st mayor vico
nya nag pag mga sec pangulong nepo
contractor
martin dizon hearing
dating read ngayon umano edsa infrastructure
senator witness state
ping officials speaker
former against panfilo bongbong
ici sarah pro tempore
isang luneta party list bong revilla
nasa engineer vince philippines
alam senador dds mas
""".split()

# Fragments that show that a location is not a place.
NON_PLACE_KEYWORDS = [
    "earth", "wherever", "worldwide", "around the world", "📍", "ig:",
    "http", "whatsapp", "telegram", "lunar", "internet", "everywhere",
    "facebook.com", "twitter.com", "t.co", "abbott", "south girl",
    "2019", "2020", "2021",
]

# Texts that a CSV reader takes as missing (the defaults of pandas).
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]

# Language codes and their labels.
LANGUAGE_LABELS = {"tl": "Filipino (tl)", "en": "English (en)", "und": "Undetermined"}

# Metric names of two source generations.
METRIC_RENAMES = {
    "retweet_count": "retweetCount",
    "reply_count": "replyCount",
    "like_count": "likeCount",
    "quote_count": "quoteCount",
    "view_count": "viewCount",
    "bookmark_count": "bookmarkCount",
}
