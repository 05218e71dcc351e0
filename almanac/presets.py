"""Parameter sets of the place-and-website study this engine has to reproduce.

Fixed values: every table here must equal the study's own, in its order, for equal
results.  Operators take them as arguments; none of them is built in.  The keyword
lists and query phrases are inputs and are read with ``sources.files.read_quoted_list``.
"""

# Name words without identity, for filling from lists and for merging two lists.
FILL_STOP_WORDS = (
    "congregation", "synagogue", "temple", "of", "the", "and", "a", "beth", "bnai", "beit", "ohev", "shalom", "israel",
    "jewish", "center", "community", "conservative", "reform", "orthodox",
)
MERGE_STOP_WORDS = ("congregation", "synagogue", "temple", "of", "the", "and", "a", "center", "community", "jewish")

# Report order of the nine categories.
CATEGORIES = (
    "Community", "Spirituality & Worship", "Kitchen", "Waste", "Energy", "Operations & Maintenance",
    "Environmental & Climate Justice", "Water", "Other",
)
FRAMINGS = ("Implicit", "Explicit", "Embedded")

# Ordered keys of the category rules; the first bucket with a contained key wins.
CATEGORY_RULES = (
    ("Environmental & Climate Justice", (
        "fossil fuel divest", "divest from any fossil", "environmental justice discussion", "indigenous peoples",
        "land acknowledgement", "indigenous communities", "climate justice action", "climate justice events",
        "educational materials about fossil", "call for action on climate change",
    )),
    ("Spirituality & Worship", (
        "symbols of nature", "reconnect with nature", "prayers/songs", "worship service to environmental",
        "items used in worship", "in worship for religious",
    )),
    ("Kitchen", (
        "food options are provided", "locally sourced food", "dishes and cutlery", "fair trade", "farmers market",
        "provides fresh vegetables",
    )),
    ("Water", (
        "low-flow aerators", "grey water", "rain barrels", "xeriscaping", "rain garden", "insulating hot water",
        "exterior watering", "high-efficiency hot water heater", "low-flush",
    )),
    ("Waste", (
        "blue bins", "recycling facilities are available", "composting", "composts regularly", "cloth bags",
        "waste reduction strategy", "eye glasses and clothes", "re-use or re-distribution", "selected from a bin",
    )),
    ("Energy", (
        "renewable energy system", "utility expenditures", "utility data", "energy efficient lighting", "heating/cooling",
        "heat pump", "insulation has been added", "programmable thermostats", "energy audit has been completed",
        "weather stripping", "ceiling fans", "caulk and spray foam", "light switches", "solar hot water",
    )),
    ("Operations & Maintenance", (
        "think twice before printing", "procurement policy for recycled", "cleaning products", "green maintenance plan",
        "sustainability coordinator", "operations committee", "well maintained and energy-efficient",
    )),
    ("Community", (
        "environmental cleanup", "board committee", "community garden for native", "stewardship focus are available",
        "educational sessions", "support sustainable public policies", "summer camp", "collaboration with other faith",
        "volunteering initiatives", "greener lifestyle", "household energy audits and water conservation", "car-pooling",
        "younger people to experience", "volunteer coordinator", "carpooling preferential parking",
        "electric vehicle charging",
    )),
)

# Canonical spellings, and the raw tags that map to them.
AFFILIATIONS = (
    "Reconstructionist", "Reform", "Jewish Renewal", "Conservative", "Non-Denominational Progressive", "Humanistic",
    "Non-Denominational Conservative", "Modern Orthodox", "Orthodox", "Chabad",
)
AFFILIATION_TAGS = {
    "chabad": "Chabad",
    "lubavitch": "Chabad",
    "orthodox": "Orthodox",
    "orthodox_jewish": "Orthodox",
    "ashkenazi_orthodox": "Orthodox",
    "orthodox_sefard": "Orthodox",
    "hasidic": "Orthodox",
    "chasidic": "Orthodox",
    "haredi": "Orthodox",
    "ultra_orthodox": "Orthodox",
    "sephardi": "Orthodox",
    "sephardic": "Orthodox",
    "mizrahi": "Orthodox",
    "mizrachi": "Orthodox",
    "mizrachi_jerusalemite": "Orthodox",
    "modern_orthodox": "Modern Orthodox",
    "modern orthodox": "Modern Orthodox",
    "orthodox_(modern)": "Modern Orthodox",
    "egalitarian_orthodox": "Modern Orthodox",
    "conservative": "Conservative",
    "conservative_jewish": "Conservative",
    "conservative_judaism": "Conservative",
    "conservative_egalitarian": "Conservative",
    "masorti": "Conservative",
    "united synagogue of conservative judaism": "Conservative",
    "reform": "Reform",
    "reformed": "Reform",
    "reform_jewish": "Reform",
    "reform_judaism": "Reform",
    "reformed_judaism": "Reform",
    "reform judaism": "Reform",
    "union of american hebrew congregations": "Reform",
    "reconstructionist": "Reconstructionist",
    "reconstructionalist": "Reconstructionist",
    "jewish renewal": "Jewish Renewal",
    "renewal": "Jewish Renewal",
    "humanistic": "Humanistic",
    "non-denominational progressive": "Non-Denominational Progressive",
    "non-denominational conservative": "Non-Denominational Conservative",
}
AFFILIATION_MERGE = {"Modern Orthodox": "Orthodox"}

# Ordered URL rules.
URL_RULES = (
    ("reconstruction", "Reconstructionist"),
    (r"modern[\-_]?orthodox", "Modern Orthodox"),
    ("chabad|lubavitch", "Chabad"),
    ("conservative", "Conservative"),
    ("reform", "Reform"),
    ("humanist", "Humanistic"),
    ("renewal", "Jewish Renewal"),
    ("orthodox", "Orthodox"),
)

# Review verdicts (case matters), and the words that retag by content.
VERDICTS = {
    "conservative": "Non-Denominational Conservative",
    "progressive": "Non-Denominational Progressive",
    "Conservative": "Conservative",
    "Orthodox": "Orthodox",
    "Reform": "Reform",
    "Chabad": "Chabad",
    "Renewal": "Jewish Renewal",
    "Reform/Conservative": "Conservative",
}
RETAG_WORDS = (
    ("Messianic Judaism", ("messianic", "yeshua", "yashua"), ("messianic", "yeshua", "yashua")),
    ("Chabad", ("chabad", "lubavitch"), ("chabad", "lubavitch")),
)

# Hosts shared by many owners.
PLATFORM_DOMAINS = (
    "facebook.com", "m.facebook.com", "godaven.com", "sites.google.com", "secure.cardknox.com", "shulspace.org",
)

# Search area and dense boxes (latitude and longitude ranges), and the feature kinds measured.
SEARCH_LAT = (24.0, 49.0)
SEARCH_LON = (-125.0, -66.0)
DENSE_BOXES = (
    (40.4, 41.4, -74.5, -71.8), (38.8, 40.2, -75.6, -73.9), (41.6, 42.5, -87.9, -87.3), (33.5, 34.5, -118.7, -117.5),
    (25.5, 26.3, -80.5, -80.0), (37.3, 37.9, -122.6, -121.7), (38.7, 39.2, -77.5, -76.8), (42.2, 42.5, -71.3, -70.9),
)
FEATURE_KINDS = ("green_space", "env_hazard", "landfill", "industrial", "abattoir", "military", "airport")
PAGE_TEXT_CAP = 500_000  # characters of page text the study stores; ``cap`` of page_text and quick_text
SILHOUETTE_OK = 0.25  # fixed value: from this mean silhouette on the study calls a cluster structure meaningful
