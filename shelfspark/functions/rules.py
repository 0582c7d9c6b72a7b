"""Word lists, lookup tables and patterns that decide results.

Everything in this file is data. The order of each list is part of its meaning:
the first entry that matches wins.
"""

# Brand -> case-insensitive patterns looked for in a product name.
BRAND_PATTERNS = [
    ("Sony", ["sony", "סוני"]),
    ("Apple", ["apple", "אפל", "iphone", "ipad", "macbook"]),
    ("Samsung", ["samsung", "סמסונג", "galaxy"]),
    ("Nike", ["nike", "נייקי"]),
    ("Adidas", ["adidas", "אדידס"]),
    ("LG", [r"\blg\b", "אל ג'י"]),
    ("Bosch", ["bosch", "בוש"]),
    ("Philips", ["philips", "פיליפס"]),
    ("Braun", ["braun", "בראון"]),
    ("Whirlpool", ["whirlpool", "וירפול"]),
    ("Electrolux", ["electrolux", "אלקטרולוקס"]),
    ("GE", [r"\bge appliances\b", r"\bge\s+(?:dishwasher|fridge|oven|washer)"]),
    ("Asus", ["asus", "אסוס"]),
    ("Lenovo", ["lenovo", "לנובו"]),
    ("HP", [r"\bhp\b", r"hewlett[\s-]?packard"]),
    ("Dell", [r"\bdell\b"]),
    ("Xiaomi", ["xiaomi", "שיאומי", "redmi", "mi band"]),
    ("Garmin", ["garmin", "גרמין"]),
    ("Logitech", ["logitech", "לוג'יטק"]),
    ("JBL", [r"\bjbl\b"]),
    ("Bose", [r"\bbose\b", "בוז"]),
    ("Edifier", ["edifier", "אדיפייר"]),
    ("Lior", ["ליאור"]),
    ("Castro", ["castro", "קסטרו"]),
    ("Fox", [r"\bfox\b", r"\bfox\s+home\b"]),
    ("Renuar", ["renuar", "רנואר"]),
]

# Brands searched as literal text, longest first.
LITERAL_BRANDS = [
    "Miele", "Bosch", "Samsung", "LG", "Siemens", "AEG", "Candy", "Beko", "Whirlpool", "Electrolux",
    "Haier", "Hisense", "Hotpoint", "Smeg", "Fisher & Paykel", "Sharp", "Panasonic", "Midea", "Ariston",
    "Indesit", "Zanussi", "Gorenje", "Liebherr", "Sub-Zero", "Thermador", "KitchenAid", "Fisher", "Teka",
    "Bertazzoni", "DeLonghi", "Nespresso", "Jura", "Saeco", "פיליפס", "Philips", "Braun",
]

# Chain -> case-insensitive patterns looked for in a store name.
CHAIN_PATTERNS = [
    ("FOX", [r"\bfox\b", "פוקס"]),
    ("FOX Home", ["fox home", "פוקס הום"]),
    ("Castro", ["castro", "קסטרו"]),
    ("Renuar", ["renuar", "רנואר"]),
    ("Greg", [r"\bgreg\b", "גרג"]),
    ("Cofix", ["cofix", "קופיקס"]),
    ("Aroma", ["aroma", "ארומה"]),
    ("Cafe Cafe", ["caf[eé] caf[eé]", "קפה קפה"]),
    ("Landwer", ["landwer", "לנדוור"]),
    ("H&M", ["h&m"]),
    ("Zara", [r"\bzara\b", "זארה"]),
    ("Mango", [r"\bmango\b", "מנגו"]),
    ("Pull&Bear", [r"pull\s*&\s*bear", "פול אנד בר"]),
    ("Bershka", ["bershka", "ברשקה"]),
    ("Stradivarius", ["stradivarius"]),
    ("Adika", ["adika", "אדיקה"]),
    ("MaxStock", ["maxstock", "max stock", "מקסטוק"]),
    ("American Eagle", ["american eagle"]),
    ("Shilav", ["shilav", "שילב"]),
    ("Babystar", ["babystar", "בייביסטאר"]),
]

# Category path -> words searched as plain substrings of a lower-cased name.
CATEGORY_KEYWORDS = [
    ("אופנה > תכשיטים", ["צמיד", "שרשרת", "טבעת", "עגיל", "תליון", "חישוק", "necklace", "bracelet", "ring", "earring"]),
    ("אופנה > הנעלה", ["נעל", "סניקרס", "מגף", "כפכף", "סנדל", "sneaker", "boot", "sandal", "shoe"]),
    ("אופנה > ביגוד", ["חולצה", "מכנס", "שמלה", "ג'ינס", "חצאית", "מעיל", "סווטשירט", "גופיי", "תחתון", "ביגוד",
                      "בגד", "shirt", "pants", "dress", "jacket"]),
    ("אופנה > תיקים", ["תיק", "ארנק", "קלאץ", "bag", "wallet", "backpack"]),
    ("יופי וטיפוח", ["איפור", "קרם", "בושם", "שמפו", "סרום", "מסכת פנים", "ליפסטיק", "מייקאפ", "makeup", "perfume",
                    "serum"]),
    ("בית ומטבח", ["כרית", "מגבת", "סיר", "צלחת", "כוס", "מצעים", "שמיכה", "וילון", "towel", "pillow", "bedding"]),
    ("צעצועים ומשחקים", ["בובה", "פאזל", "משחק", "צעצוע", "toy", "puzzle", "lego", "לגו"]),
    ("תינוקות וילדים", ["תינוק", "בגדי גוף", "מארז בגדי", "baby", "newborn", "nb "]),
    ("מזון ומשקאות", ["שוקולד", "ממתק", "קפה", "יין", "מארז מתוק", "chocolate", "wine", "coffee"]),
    ("אלקטרוניקה", ["מחשב", "אוזניות", "מטען", "כבל", "מקלדת", "עכבר", "usb", "computer", "headphone", "charger"]),
]

# Store category -> fallback category path; other store categories give none.
STORE_CATEGORY_FALLBACK = [
    ("restaurant", "מסעדות ובתי קפה"),
    ("spa", "ספא ויופי"),
    ("leisure", "פנאי ובילוי"),
    ("retail", "קמעונאות כללית"),
]

# First partner category name -> store category; anything else is "other".
PARTNER_CATEGORY_MAP = [
    ("מסעדות וקולינריה", "restaurant"),
    ("ספא וימי כיף", "spa"),
    ("מלונות ונופש", "hotel"),
    ("חוויות", "leisure"),
    ("סדנאות והעשרה", "leisure"),
    ("לגוף ולנפש", "spa"),
    ("תרבות ופנאי", "leisure"),
    ("לבית", "retail"),
    ("תינוקות וילדים", "retail"),
    ("טיפוח ויופי", "retail"),
    ("אופנה ושופינג", "retail"),
]

# Regional buckets of a city and the lower-cased spellings that lead to them.
CITY_BUCKETS = [
    (['ת"א והסביבה', "תל אביב-יפו"],
     ["תל אביב", "תל-אביב", 'ת"א', "ת״א", "תא", "יפו", "tel aviv", "telaviv", "tlv"]),
    (["ירושלים והסביבה"], ["ירושלים", "ירושלים והסביבה", "י-ם", "ים", "jerusalem"]),
    (["חיפה והסביבה"], ["חיפה", "haifa"]),
    (["אילת והערבה"], ["אילת", "eilat"]),
    (["השרון והסביבה", "רמת השרון"],
     ["הרצליה", "רעננה", "כפר סבא", "רמת השרון", "הוד השרון", "herzliya", "raanana"]),
    (["אשקלון, אשדוד והסביבה"], ["אשקלון", "אשדוד", "ashkelon", "ashdod"]),
    (["פתח תקווה ובקעת אונו"], ["פתח תקווה", 'פ"ת', "אונו", "קרית אונו", "petah tikva"]),
    (["מודיעין, השפלה והסביבה"], ["מודיעין", "modiin"]),
    (["הנגב"], ["באר שבע", "beer sheva", "beersheva"]),
    (["הגליל והגולן"], ["נצרת", "צפת", "טבריה"]),
]
# Fixed value: one-letter prefix ("in") that may stand before a city name.
CITY_PREFIX = "ב"

# Hosts that never are a store's own site (the partner site itself is a parameter).
SOCIAL_HOSTS = [
    "facebook.com", "www.facebook.com", "instagram.com", "www.instagram.com", "twitter.com", "www.twitter.com",
    "tiktok.com", "www.tiktok.com", "youtube.com", "www.youtube.com", "linkedin.com", "www.linkedin.com",
    "apple.com", "apps.apple.com", "play.google.com", "wa.me", "api.whatsapp.com",
]

# Patterns of a lower-cased URL path that mark a product page.
PRODUCT_PATH_PATTERNS = [r"/products?/", "/item/", "/p/", r"[_-]p[_-]?\d"]

# Names under which a product attribute carries the brand.
BRAND_ATTRIBUTE_NAMES = ["brand", "מותג", "manufacturer", "יצרן"]

# Phrases a reply must not hold when results came back.
CONTRADICTION_PHRASES = ["לא מצאתי", "לא מצאנו", "לא נמצא", "לא נמצאו", "no results found"]

# Words of a clarifying question that asks where the user is.
LOCATION_WORDS = ["מהיכן", "מיקום", "עיר", "GPS", "location", "where are you"]

# Fixed values: (tool, argument, fact) kept as session facts.
FACT_RULES = [
    ("search_products", "brand", "brand"),
    ("search_products", "max_price", "max_price"),
    ("search_products", "city", "city"),
    ("search_stores", "city", "city"),
]

# Fixed values: (attribute, value, icon, label) shown on the profile strip; None means any value.
PROFILE_LABELS = [
    ("has_children", "true", "👦", "ילדים"),
    ("has_children", "yes", "👦", "ילדים"),
    ("gender", "female", "👗", "קניות נשים"),
    ("gender", "male", "👔", "קניות גברים"),
    ("price_sensitivity", "budget", "💰", "חסכוני"),
    ("price_sensitivity", "premium", "💎", "פרימיום"),
]
PROFILE_CHILD_ICON, PROFILE_CHILD_PREFIX = "👦", "ילד "
PROFILE_PRICE_ICON, PROFILE_PRICE_PREFIX = "💰", "₪"
PROFILE_CITY_ICON = "📍"

# Token prices in USD and the characters one token is taken to hold.
INPUT_TOKEN_USD = 0.075 / 1_000_000
OUTPUT_TOKEN_USD = 0.30 / 1_000_000
CHARS_PER_TOKEN = 4

# Price bounds.
PRICE_SENTINEL = 999999.0
OUTLIER_FLOOR = 10.0
OUTLIER_MULTIPLE = 20.0
INSTALLMENT_LIMIT = 40.0

# Fixed value: category given when a path is not in the taxonomy.
DEFAULT_CATEGORY_PATH = "Other > Uncategorized > General Products"

# The lines of a user's context as text.
CONTEXT_HEAD = "--- הקשר אישי של המשתמש ---"
CONTEXT_BUDGET = "תקציב רגיל: עד ₪"
CONTEXT_CITIES = "ערים מועדפות: "
CONTEXT_CATEGORIES = "קטגוריות מועדפות: "
CONTEXT_SEARCHED_CITIES = "ערים שחיפש לאחרונה: "
CONTEXT_SEARCHES = "חיפושים אחרונים:"
CONTEXT_END = "--- סוף הקשר ---"
