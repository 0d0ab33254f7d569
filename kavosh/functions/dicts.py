"""Word lists, tables and patterns whose values decide results.

Fixed values: they must be these for results to agree with the reference pipeline. Order counts
where the first of several equal hits wins.
"""

# Cities and the words that speak for them.
CITIES = {
    "تهران": ("تهران", "tehran"),
    "اصفهان": ("اصفهان", "isfahan", "esfahan"),
    "مشهد": ("مشهد", "mashhad"),
    "شیراز": ("شیراز", "shiraz"),
    "تبریز": ("تبریز", "tabriz"),
    "کرج": ("کرج", "karaj"),
    "اهواز": ("اهواز", "ahvaz"),
    "قم": ("قم", "qom"),
    "کرمان": ("کرمان", "kerman"),
    "رشت": ("رشت", "rasht"),
    "همدان": ("همدان", "hamedan"),
    "یزد": ("یزد", "yazd"),
    "ارومیه": ("ارومیه", "urmia"),
    "کرمانشاه": ("کرمانشاه", "kermanshah"),
    "زاهدان": ("زاهدان", "zahedan"),
}

# Categories and the words that speak for them; GENERAL where none does.
CATEGORIES = {
    "فروشگاه": ("فروشگاه", "shop", "store", "خرید", "فروش"),
    "خدمات": ("خدمات", "service", "تعمیر", "مشاوره"),
    "رستوران": ("رستوران", "restaurant", "کافه", "cafe"),
    "پزشکی": ("پزشک", "کلینیک", "بیمارستان", "clinic", "doctor", "درمان"),
    "املاک": ("املاک", "ملک", "آپارتمان", "real estate", "مسکن"),
    "آموزش": ("آموزش", "آموزشگاه", "مدرسه", "university", "institute", "course"),
    "فناوری": ("نرم‌افزار", "نرم افزار", "برنامه", "سایت", "اپلیکیشن", "it", "software", "technology"),
    "حمل و نقل": ("باربری", "حمل", "ارسال", "پیک", "transport"),
}
GENERAL = "عمومی"

# Signatures of technologies as (pattern, weight, where).
TECHNOLOGIES = {
    "WordPress": (
        (r"wp-content", 0.95, "html"), (r"wp-includes", 0.95, "html"), (r"/wp-json/", 0.9, "html"), (r"api\.w\.org", 0.95, "html"), (r"wp-embed", 0.85, "html"), (r"wp-emoji", 0.7, "html"),
        (r"wp-block", 0.65, "html"), (r"<meta[^>]+name=['\\\"]generator['\\\"][^>]+content=['\\\"]wordpress", 0.95, "html"), (r"wordpress", 0.75, "html"),
    ),
    "WooCommerce": (
        (r"woocommerce", 1.0, "html"), (r"wc-block", 0.9, "html"), (r"wc-add-to-cart", 0.95, "html"), (r"woocommerce-product", 0.9, "html"), (r"wc-api", 0.8, "html"), (r"wc-ajax", 0.85, "html"),
        (r"woocommerce_(?:session|cart)", 0.9, "html"), (r"woocommerce", 0.9, "header"),
    ),
    "Joomla": ((r"/media/jui/", 0.9, "html"), (r"/components/com_", 0.9, "html"), (r"joomla", 0.75, "html")),
    "Drupal": ((r"drupal.settings", 0.95, "html"), (r"/sites/default/files", 0.85, "html"), (r"drupal", 0.7, "html")),
    "Shopify": ((r"cdn.shopify.com", 0.98, "html"), (r"shopify.theme", 0.95, "html"), (r"shopify", 0.75, "html"), (r"myshopify.com", 0.9, "url")),
    "Magento": ((r"mage.cookies", 0.95, "html"), (r"/static/version", 0.85, "html"), (r"magento", 0.7, "html")),
    "PrestaShop": ((r"prestashop", 0.9, "html"),),
    "OpenCart": ((r"catalog/view/theme", 0.9, "html"), (r"opencart", 0.8, "html")),
    "Laravel": ((r"laravel_session", 0.95, "header"), (r"xsrf-token", 0.7, "header"), (r"laravel", 0.55, "html")),
    "Next.js": ((r"_next/static", 0.98, "html"), (r"__NEXT_DATA__", 0.98, "html")),
    "React": ((r"data-reactroot", 0.85, "html"), (r"__REACT", 0.65, "html")),
    "Vue.js": ((r"data-v-[a-z0-9]", 0.75, "html"),),
    "Angular": ((r"ng-version", 0.95, "html"),),
    "Bootstrap": ((r"bootstrap", 0.65, "html"), (r"bootstrap.min.css", 0.9, "link")),
    "jQuery": ((r"jquery.min.js", 0.9, "script"), (r"jquery", 0.55, "script")),
    "Cloudflare": ((r"cloudflare", 0.75, "html"), (r"cf-ray", 0.98, "header")),
    "Google Analytics": ((r"google-analytics.com", 0.9, "html"), (r"googletagmanager.com", 0.7, "html"), (r"gtag\(", 0.75, "html")),
    "Google Tag Manager": ((r"googletagmanager.com", 0.95, "html"), (r"GTM-[A-Z0-9]+", 0.9, "html")),
}

# The order in which technologies are shown.
TECHNOLOGY_ORDER = (
    "WordPress", "WooCommerce", "Shopify", "Magento", "PrestaShop", "OpenCart", "Joomla", "Drupal", "Laravel", "Next.js", "React", "Vue.js", "Angular", "Bootstrap", "jQuery", "Cloudflare",
    "Google Tag Manager", "Google Analytics",
)

# Hosts of platforms, which are no sites of their own.
PLATFORM_HOSTS = (
    "google.com", "googleusercontent.com", "googleapis.com", "business.google.com", "developers.cafebazaar.ir", "cafebazaar.ir", "developer.myket.ir", "myket.ir", "ble.ir", "t.me", "telegram.me",
    "telegram.dog", "instagram.com", "facebook.com", "linkedin.com", "twitter.com", "x.com", "youtube.com", "youtu.be", "wa.me", "api.whatsapp.com",
)

# Names that name no business.
GENERIC_NAMES = (
    "", "website", "web site", "home", "homepage", "صفحه اصلی", "خانه", "سایت", "وب سایت", "وب‌سایت", "google", "google business", "developers", "developer", "cafe bazaar", "bazaar", "myket",
)

# Query parameters dropped from canonical URLs, extensions never crawled, and types of resource links.
TRACKING_PARAMS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "mc_cid", "mc_eid")
SKIP_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "webp", "svg", "pdf", "zip", "rar", "mp4", "mp3", "css", "js", "woff", "woff2")
RESOURCE_TYPES = ("script", "image", "iframe", "frame", "video", "audio", "source", "object", "srcset")

# Hosts of social networks; the first network that fits is taken.
SOCIAL_HOSTS = {
    "instagram": ("instagram.com",),
    "telegram": ("t.me", "telegram.me", "telegram.dog", "telegram.com"),
    "linkedin": ("linkedin.com",),
    "twitter": ("twitter.com", "x.com"),
    "facebook": ("facebook.com", "fb.com"),
    "youtube": ("youtube.com", "youtu.be"),
}

# Operator prefixes of mobile numbers and area codes of landlines.
MOBILE = r"09(?:0[1-5]|1[0-9]|2[0-2]|3[0-9]|9[0-9])[0-9]{7}"
AREA_CODES = ("21", "26", "25", "31", "41", "51", "61", "71", "81", "11", "13", "17", "34", "35", "38", "44", "45", "54", "56", "58", "74", "76", "77", "83", "84", "86", "87")

# Words of paths by crawling priority, best first, and the priority of all others.
PRIORITIES = ((30, "contact|تماس|tamas"), (28, "about|درباره"), (24, "service|support|help|خدمات"), (20, "product|shop|store|catalog|category|محصول|فروشگاه"))
OTHER_PRIORITY = 5

# Weights of the parts of a quality score.
QUALITY = {"phones": 0.35, "emails": 0.25, "socials": 0.10, "technologies": 0.10, "name": 0.10, "city": 0.10, "address": 0.10}

# Forms of e-mail addresses in free text, as stored, and in the reduced profile.
EMAIL_IN_TEXT = r"(?U)(?<![\w.+-])([a-zA-Z0-9][a-zA-Z0-9._%+\-]{0,63}@[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z]{2,63})+)(?![\w.-])"
EMAIL_STORED = r"^[a-z0-9][a-z0-9._%+\-]*@[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?(?:\.[a-z0-9\-]+)*\.[a-z]{2,63}$"
EMAIL_LITE = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
