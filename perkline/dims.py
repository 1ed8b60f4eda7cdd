"""Fixed lookup values the results depend on, as plain text."""

from __future__ import annotations

# Valid merchant category codes used by the cleaning step.
VALID_MCC = [
    5411, 5422, 5441, 5451, 5462,
    5812, 5813, 5814,
    5541, 5542,
    3000, 3001, 4511, 4722, 7011, 7512,
    5691, 5699, 5944, 5945, 5947,
    4899, 5815, 5816, 5818,
    4900, 4814, 4816,
    6300, 6381, 5960,
    7832, 7922, 7941, 7991, 7999,
    5912,
    5200, 5211, 5231, 5251, 5261,
    4111, 4112, 4121, 4131,
    5999,
]

# Merchant category code ranges (low, high, category).
MCC_RANGES = [
    (5811, 5814, "dining"),
    (5462, 5462, "dining"),
    (3000, 3350, "travel"),
    (4511, 4511, "travel"),
    (4722, 4722, "travel"),
    (3501, 3838, "travel"),
    (7011, 7012, "travel"),
    (4011, 4011, "travel"),
    (4111, 4112, "travel"),
    (4121, 4121, "travel"),
    (4131, 4131, "travel"),
    (4411, 4411, "travel"),
    (4789, 4789, "travel"),
    (7512, 7512, "travel"),
    (5541, 5542, "gas"),
    (5411, 5411, "groceries"),
    (5422, 5422, "groceries"),
    (5441, 5441, "groceries"),
    (5451, 5451, "groceries"),
    (5499, 5499, "groceries"),
    (4899, 4899, "streaming"),
    (5815, 5818, "streaming"),
    (5942, 5942, "online_shopping"),
    (5943, 5943, "online_shopping"),
    (5944, 5947, "online_shopping"),
    (5964, 5964, "online_shopping"),
    (5965, 5966, "online_shopping"),
    (5912, 5912, "drugstores"),
    (7832, 7833, "entertainment"),
    (7911, 7911, "entertainment"),
    (7922, 7922, "entertainment"),
    (7929, 7929, "entertainment"),
    (7932, 7933, "entertainment"),
    (7941, 7941, "entertainment"),
    (7991, 7999, "entertainment"),
    (4812, 4816, "utilities"),
    (4900, 4900, "utilities"),
]

# Exact codes that win over ranges.
MCC_EXACT = {
    5812: "dining",
    5813: "dining",
    5814: "dining",
    5541: "gas",
    5542: "gas",
    5411: "groceries",
    5912: "drugstores",
}
# Fixed value: category of other merchant codes.
MCC_DEFAULT = "general"

# Issuer spellings mapped to one name.
ISSUER_ALIASES = {
    "AMEX": "AMERICAN EXPRESS",
    "AMERICANEXPRESS": "AMERICAN EXPRESS",
    "BOFA": "BANK OF AMERICA",
    "BOA": "BANK OF AMERICA",
    "CAPITALONE": "CAPITAL ONE",
    "CAP ONE": "CAPITAL ONE",
    "USBANK": "US BANK",
    "U.S. BANK": "US BANK",
    "WELLSFARGO": "WELLS FARGO",
}

# Acronyms restored after title case.
ACRONYMS = {"Amex": "AMEX", "Aaa": "AAA", "Ihg": "IHG", "Usb": "USB"}

# Cents per reward unit by currency.
CENTS_PER_UNIT = {
    "CASHBACK": 100.0,
    "USD": 100.0,
    "POINTS": 1.0,
    "MILES": 1.2,
    "DELTA": 1.3,
    "UNITED": 1.2,
    "AMERICAN": 1.5,
    "MARRIOTT": 0.8,
    "HILTON": 0.5,
    "HYATT": 1.7,
}

# Dollars per point by redemption preference.
POINT_VALUE = {
    "cash_back": 0.01,
    "statement_credit": 0.01,
    "travel_portal": 0.015,
    "travel_transfer": 0.02,
    "gift_cards": 0.009,
    "merchandise": 0.008,
}

# Order of age groups.
AGE_ORDINAL = {"18-25": 1, "26-35": 2, "36-50": 3, "51-65": 4, "65+": 5}

# Plausible monthly budget by archetype.
ARCHETYPE_BUDGET = {
    "minimal_user": (0.0, 2000.0),
    "budget_conscious": (500.0, 5000.0),
    "young_professional": (1500.0, 8000.0),
    "suburban_family": (3000.0, 15000.0),
    "frequent_traveler": (2500.0, 12000.0),
    "high_roller": (5000.0, 30000.0),
    "category_specialist": (1000.0, 10000.0),
}
# Archetypes, age groups, locations and redemption preferences.
ARCHETYPES = [
    "young_professional",
    "suburban_family",
    "frequent_traveler",
    "budget_conscious",
    "high_roller",
    "minimal_user",
    "category_specialist",
]
AGE_GROUPS = ["18-25", "26-35", "36-50", "51-65", "65+"]
LOCATIONS = ["urban", "suburban", "rural"]
REDEMPTIONS = ["cash_back", "travel_transfer", "statement_credit", "gift_cards", "merchandise", "travel_portal"]

# Categories accepted by the transaction contract.
TXN_CATEGORIES = [
    "groceries", "dining", "gas", "travel", "online_shopping", "streaming", "utilities",
    "insurance", "entertainment", "drugstore", "home_improvement", "transit", "other", "unknown",
]

# Categories a scoring request may name.
SPENDING_CATEGORIES = [
    "groceries", "dining", "travel", "gas", "online_shopping", "entertainment",
    "utilities", "streaming", "drugstores", "general", "other",
]

# Categories a card may carry a bonus for.
BONUS_CATEGORIES = [
    "dining", "groceries", "travel", "gas", "streaming", "entertainment", "online_shopping", "drugstore",
]

# Persona name -> (description, annual fee multiplier, category boosts).
PERSONAS = {
    "student": ("Minimize fees, favor no-fee simple cashback", 2.0, {}),
    "traveler": ("Maximize travel multipliers and transferable points", 0.5, {"travel": 1.5, "dining": 1.2}),
    "family": ("Groceries, gas, and utilities focus", 0.8, {"groceries": 1.5, "gas": 1.3, "utilities": 1.2}),
    "cashback-focused": ("Flat-rate cashback simplicity", 1.0, {}),
}

# Default monthly spend profile of the savings calculator.
DEFAULT_SPEND = {"dining": 200.0, "groceries": 400.0, "travel": 150.0, "gas": 100.0, "other": 150.0}

# Hand-checked cards that always win over loaded ones.
# (card_id, card_name, issuer, annual_fee, base rate, category bonuses)
CURATED_CARDS = [
    ("amex_gold", "Amex Gold Card", "American Express", 250.0, 1.0, {"dining": 4.0, "groceries": 4.0}),
    ("chase_sapphire_preferred", "Chase Sapphire Preferred", "Chase", 95.0, 1.0, {"travel": 3.0, "dining": 3.0}),
    ("capital_one_venture_x", "Capital One Venture X", "Capital One", 395.0, 2.0, {"travel": 5.0}),
    ("citi_double_cash", "Citi Double Cash", "Citi", 0.0, 2.0, {}),
    ("blue_cash_preferred", "Blue Cash Preferred", "American Express", 95.0, 1.0,
     {"groceries": 6.0, "streaming": 6.0, "gas": 3.0}),
    ("capital_one_savor", "Capital One Savor", "Capital One", 0.0, 1.0,
     {"dining": 3.0, "entertainment": 3.0, "groceries": 3.0}),
    ("chase_freedom_unlimited", "Chase Freedom Unlimited", "Chase", 0.0, 1.5, {"dining": 3.0, "travel": 2.0}),
    ("wells_fargo_autograph", "Wells Fargo Autograph", "Wells Fargo", 0.0, 1.0,
     {"dining": 3.0, "travel": 3.0, "gas": 3.0, "streaming": 3.0}),
    ("discover_it_cash_back", "Discover it Cash Back", "Discover", 0.0, 1.0, {"gas": 5.0, "online_shopping": 5.0}),
]

# Name prefixes of list headings that are not cards.
MERGE_JUNK_PREFIXES = [
    "best for:", "our pick for:", "best overall", "top pick", "editor's pick", "best cash back", "best travel",
]
CATALOG_JUNK_PREFIXES = ["best for:", "our pick for:", "2026best", "best credit card"]

# Merchant keywords by category; the first category in this order wins.
MERCHANT_WORDS = {
    "dining": [
        "doordash", "door dash", "uber eats", "ubereats", "grubhub", "grub hub", "instacart", "seamless", "caviar", "postmates", "gopuff",
        "mcdonald", "chick-fil-a", "chickfila", "wendy", "burger king", "taco bell", "popeyes", "five guys", "in-n-out", "shake shack", "sonic",
        "dairy queen", "kfc", "papa john", "domino", "little caesar",
        "chipotle", "starbucks", "dunkin", "panera", "subway", "panda express", "olive garden", "applebee", "chili", "texas roadhouse", "outback",
        "cheesecake factory", "denny", "ihop", "waffle house",
        "restaurant", "cafe", "coffee", "bakery", "diner", "eatery", "steakhouse", "grill", "pizzeria", "pizza", "sushi", "ramen", "taqueria",
        "bar & grill", "gastropub", "bistro", "brasserie", "cantina", "trattoria",
    ],
    "groceries": [
        "whole foods", "trader joe", "kroger", "safeway", "publix", "wegmans", "aldi", "sprouts", "meijer", "stop & shop", "stop and shop", "giant",
        "food lion", "heb", "grocery", "supermarket", "market basket", "winco", "piggly wiggly", "fresh market", "albertson", "vons", "ralphs",
        "tom thumb", "randall", "winn-dixie", "shoprite", "costco", "sam's club", "bj's wholesale",
    ],
    "travel": [
        "delta", "united airlines", "american airlines", "southwest", "jetblue", "alaska airlines", "spirit airlines", "frontier airlines", "hawaiian airlines",
        "marriott", "hilton", "hyatt", "ihg", "wyndham", "best western", "radisson", "holiday inn", "sheraton", "westin", "ritz-carlton", "four seasons",
        "kimpton", "motel", "hotel", "resort",
        "airbnb", "vrbo", "expedia", "booking.com", "hotels.com", "priceline", "kayak", "orbitz", "hotwire", "travelocity",
        "uber", "lyft", "enterprise", "hertz", "avis", "budget rent", "national car", "alamo", "dollar rent", "amtrak", "greyhound", "megabus",
    ],
    "gas": [
        "shell", "bp", "chevron", "exxon", "mobil", "texaco", "citgo", "marathon", "sunoco", "valero", "arco", "76 gas", "casey", "kwik trip", "wawa",
        "sheetz", "speedway", "circle k", "gas station", "fuel", "gasoline",
    ],
    "streaming": [
        "netflix", "hulu", "disney+", "disney plus", "hbo", "max", "peacock", "paramount+", "paramount plus", "apple tv", "amazon prime video",
        "prime video", "crunchyroll", "fubo", "sling", "youtube premium", "spotify", "apple music", "tidal", "pandora", "sirius", "deezer", "audible",
    ],
    "entertainment": [
        "amc", "regal", "cinemark", "imax", "cinema", "theater", "ticketmaster", "stubhub", "eventbrite", "livenation", "live nation", "seatgeek",
        "gamestop", "playstation", "xbox", "nintendo", "steam", "twitch", "bowling", "topgolf", "dave & buster", "escape room", "laser tag",
        "miniature golf", "arcade",
    ],
    "online_shopping": [
        "amazon", "ebay", "etsy", "shopify", "wayfair", "chewy", "zappos", "overstock", "newegg", "adorama", "b&h photo", "bestbuy.com", "best buy",
        "apple store", "apple.com", "walmart.com", "target.com",
    ],
    "drugstore": ["cvs", "walgreens", "rite aid", "duane reade", "pharmacy", "drug mart", "health mart"],
}

# Advice by what a bias metric's name contains; the first match counts.
PROMPT_ADVICE = [
    ("length", "Add explicit length guidance to prompts: 'Provide explanations of 50-100 words regardless of user profile.'"),
    ("readability", "Add readability constraint: 'Write at an 8th-grade reading level for all users.'"),
    ("detail", "Standardize detail level: 'Include exactly 3 key factors in every explanation.'"),
]

# Sentences on personas, with the places of their values.
PERSONA_REASON = {
    "match": "Matches {personas} ({notes}).",
    "boost": "{category} rewards boosted ×{boost} for this persona.",
    "no_fee": "No annual fee — ideal for fee-sensitive personas.",
    "fee_up": "{fee} annual fee is penalised under fee-sensitive persona.",
    "fee_down": "{fee} annual fee is discounted — persona favours premium benefits.",
    "none": "No active persona — ranked by raw reward value.",
}
PERSONA_CONTEXT = {
    "active": "Active personas: {personas}.",
    "boost": "Category reward boosted ×{boost}.",
    "fee": "Annual fee sensitivity {way} (×{fee}).",
}

# Sentences on cards, with the places of their values.
CARD_TEXTS = {
    "first": "Top pick for your spending profile. {name} earns {rate} on {category}, projecting {money}/year in rewards.",
    "other": "{name} earns {rate} on {category}. Projected annual reward: {money}.",
    "boosted": " Boosted by your {personas} profile.",
    "template_bonus": "Strong match for {category} spend at {rate}% deterministic reward rate.",
    "template_base": "Consistent base rewards card with {rate}% return.",
    "pro_bonus": "{highlight} — strong for your spending pattern",
    "pro_flat": "Flat {rate} on all purchases — no category tracking needed",
    "pro_no_fee": "No annual fee keeps your net rewards positive from day one",
    "pro_offset": "Projected {money}/year in rewards more than offsets the {fee} annual fee",
    "pro_reward": "Projected annual reward of {money} across your spending categories",
    "con_fee": "{fee}/year annual fee requires consistent spending to offset",
    "con_base": "Lower base rate on purchases outside bonus categories",
    "con_flat": "No bonus categories — specialized cards may earn more in your top areas",
    "con_missing": "No bonus rate for {category} — your {place} spending category",
    "con_points": "Rewards value depends on how you redeem points",
    "con_other": "Other cards may offer higher rates in specific spending categories",
    "for_focus": "{personas} spenders focused on {category}",
    "for_flat": "{personas} spenders looking for simple flat-rate rewards",
    "for_category": "Spenders with high {category} purchases",
    "for_everyday": "Everyday spenders who prefer simplicity over category optimization",
}

# Phrases that state a reward rate, in order of precedence (last wins).
RATE_PHRASES = [
    (r"(\d+(?:\.\d+)?)\s*%\s*(?:cash\s*back|back)\s+(?:on\s+)?([a-zA-Z\s,&]+?)(?:\.|,|and\s+\d|\s+\d)", "cashback"),
    (r"(\d+)[xX]\s*(?:points?\s+)?(?:on\s+)?([a-zA-Z\s,&]+?)(?:\.|,|and\s+\d|\s+\d)", "points"),
    (r"[Ee]arn\s+(\d+)[xX]\s+(?:on\s+)?([a-zA-Z\s,&]+?)(?:\.|,|and\s+\d|\s+\d)", "points"),
]

# Patterns of welcome bonus texts.
BONUS_CASH_FIRST = r"^\s*\$\s*([\d,]+)"
BONUS_COUNTED = r"([\d,]+)\s*(points?|miles?|dollars?)"
BONUS_CASH = r"\$\s*([\d,]+)"
BONUS_SPEND = r"(?:after|spend|spending)\s*\$?\s*([\d,]+)"
BONUS_TIME = r"(\d+)\s*(month|day|week)"
