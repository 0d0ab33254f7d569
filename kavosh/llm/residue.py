"""Template residue, filler, error messages and script notices in place of content.

Four character n-gram models of residue (unfilled templates; filler; error and out-of-service messages; notices about scripts
and browser checks) are fitted on the examples below, which are known from public servers, engines and page builders, and one of
natural prose on a corpus of texts, on ordinary titles, and on the titles at hand. Along a text the log-likelihood ratio of the likeliest residue
model to natural prose is summed over windows; the window with the largest sum in each part of a title (parts being set off by
bars, dashes, bullets or guillemets) localises residue, and a text is excluded if such a window is likely enough and covers most of a part.

Titles at hand name things no corpus knows, but hold residue too, which must not pass for natural because it is frequent. So they
are judged first against the corpus alone, and all but those that are residue by far (``CLEARLY``) are counted as natural.

The models are tables of 2**18 hashed counts, whatever the size of the corpus: counting is a
partial aggregate per split and a sum per bucket, and only the table travels to the workers.

Results: NULL and blank texts are no case; garbled ones are judged as restored; a text is
judged by itself, so repeated rows are judged alike; an empty table gives no rows; without a corpus the ordinary titles alone are natural.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kavosh.llm.garble import repaired
from kavosh.sources.tables import spread

ORDER = 5
BITS = 18
#: Pull of the next lower order, in pseudo-counts: for residue, of which the examples are a choice,
#: and for natural prose, where a stray leftover of residue must not pass for usual.
PULL, NATURAL_PULL = 1.0, 5.0
#: Least log-likelihood ratio of a window and of a part as a whole, and least share of a part a window must cover.
LEAST_RATIO, LEAST_WHOLE, LEAST_COVER = 9.0, 3.5, 0.72
#: A part with this ratio as a whole (or this much a character, if it is short) against the corpus alone is residue by far.
CLEARLY, CLEARLY_EACH = 7.0, 0.8
#: Characters the corpus and the titles at hand count for at most, so that a larger table shifts no balance.
CORPUS_MASS, TITLE_MASS = 15e6, 4e5
#: How often an example counts, so that what follows it is known well.
WEIGHT = 12

#: Templates whose slots were never filled: how engines write a slot, and what slots are called.
_FORMS = ("{{{{{}}}}}", "{{{{ {} }}}}", "{{{{{{{}}}}}}}", "{{{}}}", "${{{}}}", "{{${}}}", "{{% {} %}}", "<%= {} %>", "<% {} %>", "<?= ${} ?>", "<?php echo ${} ?>", "<?php echo {}; ?>", "%%{}%%", "%{}%", "[{}]", "[[{}]]", "[%{}%]", ":{}:", "#{}#", "##{}##", "@@{}@@", "@{}", "__{}__", "{{#{}}}", "<{}>", "&lt;{}&gt;", "*|{}|*", "!!{}!!", "$({})")
_OWNERS = ("", "page.", "site.", "post.", "product.", "seo.")
_SLOTS = ("title", "name", "site_name", "company", "company_name", "brand", "category", "heading", "headline", "page_title", "meta_title", "post_title", "shop_name", "store_name", "business_name", "description", "author", "keyword", "slug", "label", "content", "placeholder", "site_title", "subtitle")
PLACEHOLDERS = tuple(form.format(owner + slot) for form in _FORMS for owner in _OWNERS for name in _SLOTS for slot in dict.fromkeys((name, name.replace("_", ""))) if not (owner and "_" in slot))

#: What a script leaves where it had no value; as common as all other filler together, and words of prose in some languages.
UNSET = ("undefined", "null", "nan", "none", "[object object]")
FILLER = (
    "undefined undefined", "null null", "none none", "object object", "n/a", "nil", "void 0", "function () { [native code] }",
    "lorem ipsum", "lorem ipsum dolor sit amet", "lorem ipsum dolor sit amet consectetur adipiscing elit", "sed do eiusmod tempor incididunt ut labore et dolore magna aliqua", "ut enim ad minim veniam quis nostrud exercitation ullamco laboris", "duis aute irure dolor in reprehenderit",
    "excepteur sint occaecat cupidatat non proident", "lipsum dolor", "dummy text", "placeholder text", "placeholder", "sample text", "some text here", "text goes here", "your text here", "add your text", "type something", "insert text here",
    "title", "your title", "your title here", "title here", "title goes here", "page title", "page title here", "page title goes here", "insert title here", "insert page title", "insert your title", "add title", "add a title", "enter title here", "edit this title", "site title", "site title here", "document title", "default title", "no title", "title not set", "missing title", "change me", "heading goes here",
    "your site name", "your site name here", "your website name", "your website title", "your company", "your company name", "your company name here", "your business name", "your name here", "company name", "company name here", "business name here", "brand name", "my site", "my website", "my blog", "my first website", "my new site", "my wordpress site", "site name", "website name goes here", "your tagline here", "slogan goes here",
    "untitled", "untitled document", "untitled page", "untitled-0", "untitled 0", "untitled site", "untitled post", "new page", "new page 0", "new document", "new site", "new website", "blank page", "empty page", "page 0", "document", "document 0", "index", "default page", "default web site page", "homepage title", "home page title",
    "just another wordpress site", "just another weblog", "hello world", "hello world!", "sample page", "sample post", "sample page", "uncategorized", "another joomla site", "joomla home", "welcome to joomla", "welcome to drupal", "welcome to your new site", "welcome to your store", "my store powered by", "create react app", "react app", "vue app", "vite app", "vite + react", "next app", "create next app", "angular app", "laravel", "django site admin", "powered by wordpress",
    "welcome to nginx!", "welcome to nginx on debian!", "apache0 default page: it works", "apache0 ubuntu default page: it works", "it works!", "test page for the apache http server", "test page for the nginx http server", "iis windows server", "iis0", "welcome to centos", "web server's default page", "plesk default page", "cpanel default page", "index of /", "index of /public_html", "index of /example.com", "directory listing for /", "phpinfo()", "parent directory",
    "coming soon", "coming soon page", "coming soon page template", "site coming soon", "launching soon", "opening soon", "website under development", "site not published yet", "this site is not published", "this domain is parked", "domain parked", "parked domain", "demo site", "demo page", "demo store", "demo content", "example", "example domain", "example page", "example site", "landing page template", "blank template", "one page template", "free html template", "bootstrap template", "starter template", "theme preview",
    "todo", "todo: title", "todo title", "todo: add title", "tbd", "fixme", "xxx", "xxx xxx", "xxxx xxxx xxxx", "asdf", "asdf asdf", "asdfgh", "asdfghjkl", "qwerty", "qwertyuiop", "asdfgh qwerty", "test", "test test", "test test test", "test page", "test site", "test title", "testing 000", "aaa", "aaaa aaaa", "abc abc", "foo bar", "foo bar baz", "blah blah blah",
    "لورم ایپسوم", "لورم ایپسوم متن ساختگی", "متن ساختگی", "متن ساختگی با تولید سادگی نامفهوم از صنعت چاپ", "متن آزمایشی", "متن نمونه", "متن تستی", "متن شما اینجا", "متن خود را وارد کنید", "تست", "تست تست", "تست تست تست", "تستی", "آزمایشی", "این یک متن آزمایشی است",
    "عنوان", "عنوان صفحه", "عنوان سایت", "عنوان سایت شما", "عنوان خود را وارد کنید", "عنوان را اینجا وارد کنید", "عنوان را وارد کنید", "عنوان اینجا", "عنوان خود را بنویسید", "عنوان پیش فرض", "نام سایت", "نام سایت شما", "نام شرکت", "نام شرکت شما", "نام شرکت خود را وارد کنید", "نام فروشگاه شما", "نام کسب و کار شما", "اسم سایت خود را بنویسید", "شعار سایت شما",
    "بدون عنوان", "بدون نام", "صفحه بدون عنوان", "سند بدون عنوان", "صفحه جدید", "نوشته جدید", "برگه نمونه", "نوشته نمونه", "سلام دنیا", "سلام دنیا!", "سایتی دیگر با وردپرس", "یک سایت وردپرسی دیگر", "یک وبلاگ وردپرسی دیگر", "قدرت گرفته از وردپرس", "به زودی", "سایت به زودی راه اندازی می شود", "به وردپرس خوش آمدید", "اولین نوشته شما", "دسته بندی نشده", "قالب آماده", "صفحه پیش فرض",
)
ERRORS = (
    "error", "error 000", "error 0000", "error code 000", "error code: 0000", "http error 000", "http 000", "http status 000", "http status 000 – not found", "status code 000", "000 error", "000 page", "error page", "an error", "fatal error", "unknown error", "unexpected error", "runtime error", "script error", "server error", "internal error", "application error", "system error", "network error", "connection error", "database error", "critical error",
    "not found", "000 not found", "page not found", "000 page not found", "000 - page not found", "file not found", "object not found", "resource not found", "url not found", "content not found", "nothing found", "nothing was found", "the page cannot be found", "the page you are looking for could not be found", "the page you requested was not found", "that page can't be found", "oops! that page can’t be found", "oops! page not found", "oops, nothing here", "sorry, this page isn't available", "this page isn't available", "page isn’t available right now", "page unavailable", "page does not exist", "this page doesn't exist", "the requested url was not found on this server", "no such page", "cannot get /", "invalid url", "whitelabel error page", "missing page",
    "bad request", "000 bad request", "bad request - invalid hostname", "unauthorized", "000 unauthorized", "authorization required", "payment required", "forbidden", "000 forbidden", "000 - forbidden: access is denied", "access denied", "access is denied", "access forbidden", "permission denied", "you don't have permission to access this resource", "you do not have access", "access to this page has been denied", "access restricted", "access denied: example.com used cloudflare to restrict access", "method not allowed", "000 method not allowed", "not acceptable", "request timeout", "000 request time-out", "conflict", "gone", "000 gone", "too many requests", "000 too many requests", "rate limit exceeded", "request blocked", "you have been blocked", "error 0000: access denied",
    "internal server error", "000 internal server error", "http status 000 - internal server error", "the server encountered an internal error", "not implemented", "bad gateway", "000 bad gateway", "error 000: bad gateway", "service unavailable", "000 service unavailable", "000 service temporarily unavailable", "service temporarily unavailable", "the service is unavailable", "server unavailable", "temporarily unavailable", "temporarily offline", "gateway timeout", "gateway time-out", "000 gateway timeout", "000 gateway time-out", "backend fetch failed", "error 000 backend fetch failed", "guru meditation", "upstream connect error", "no healthy upstream", "web server is down", "web server is returning an unknown error", "origin is unreachable", "origin dns error", "a timeout occurred", "connection timed out", "connection refused", "connection reset", "ssl handshake failed", "invalid ssl certificate", "this site can’t be reached", "this site can't provide a secure connection", "your connection is not private", "server not found", "unable to connect", "problem loading page", "dns_probe_finished_nxdomain", "err_connection_refused",
    "server error in '/' application", "something went wrong", "whoops, looks like something went wrong", "oops! something went wrong", "oops, an error occurred", "an error occurred", "an error has occurred", "an unexpected error has occurred", "error occurred", "there has been a critical error on this website", "there was an error processing your request", "we're sorry, but something went wrong", "exception", "unhandled exception", "uncaught exception", "java.lang.nullpointerexception", "traceback (most recent call last)", "application error: a client-side exception has occurred", "uncaught typeerror: cannot read properties of undefined", "module not found",
    "fatal error: uncaught error: call to undefined function", "fatal error: allowed memory size of 00000000 bytes exhausted", "fatal error: maximum execution time of 00 seconds exceeded", "fatal error: call to undefined function", "parse error: syntax error, unexpected", "parse error: syntax error, unexpected end of file", "warning: include(): failed opening", "warning: mysqli_connect(): (hy000/0000)", "warning: mysqli_connect(): (hy000/0000): access denied for user", "warning: cannot modify header information", "warning: undefined variable", "notice: undefined index", "notice: undefined variable", "deprecated: function", "strict standards", "stack trace", "error establishing a database connection", "database connection error", "database connection failed", "database error", "could not connect to database", "could not connect to the database server", "sqlstate[hy000] [0000] connection refused", "mysql server has gone away", "access denied for user 'root'@'localhost'", "unable to open database", "query failed",
    "account suspended", "this account has been suspended", "account disabled", "account deactivated", "website suspended", "site suspended", "hosting account expired", "your hosting has expired", "domain expired", "domain has expired", "this domain has expired", "this domain is for sale", "domain for sale", "buy this domain", "this domain may be for sale", "bandwidth limit exceeded", "000 bandwidth limit exceeded", "resource limit is reached", "quota exceeded", "license expired", "website disabled", "site blocked", "site closed", "store closed", "this store is unavailable", "this shop is currently unavailable",
    "maintenance", "maintenance mode", "under maintenance", "site under maintenance", "down for maintenance", "closed for maintenance", "scheduled maintenance", "briefly unavailable for scheduled maintenance", "under construction", "site under construction", "this site is under construction", "page under construction", "site offline", "site is down", "offline for maintenance", "we'll be back soon", "we will be back soon", "be right back", "back soon", "upgrading our site",
    "خطا", "خطای 000", "خطای 0000", "خطا 000", "کد خطا 000", "خطای سرور", "خطای داخلی سرور", "خطای سیستم", "خطای ناشناخته", "خطای دسترسی", "خطای پایگاه داده", "خطای اتصال", "خطا در برقراری ارتباط", "خطا در برقراری ارتباط با پایگاه داده", "خطا در اتصال به پایگاه داده", "خطا در ارتباط با سرور", "خطایی رخ داد", "خطایی رخ داده است", "مشکلی پیش آمده است", "یک خطای مهم در این وب سایت رخ داده است", "خطای 000: صفحه یافت نشد", "خطای 000 صفحه پیدا نشد",
    "یافت نشد", "پیدا نشد", "صفحه یافت نشد", "صفحه پیدا نشد", "صفحه مورد نظر یافت نشد", "صفحه مورد نظر شما پیدا نشد", "صفحه درخواستی یافت نشد", "متاسفانه صفحه مورد نظر یافت نشد", "این صفحه وجود ندارد", "چیزی یافت نشد", "آدرس نامعتبر", "درگاه نامعتبر", "درخواست نامعتبر", "دسترسی غیرمجاز", "خطای 000: دسترسی غیرمجاز", "دسترسی ندارید", "شما دسترسی ندارید", "دسترسی مسدود است", "دسترسی به این صفحه محدود شده است", "ورود ممنوع",
    "سرویس در دسترس نیست", "سایت در دسترس نیست", "این سایت در دسترس نیست", "سرور در دسترس نیست", "سایت موقتا در دسترس نیست", "در حال حاضر در دسترس نیست", "حساب مسدود شده است", "حساب شما مسدود شده است", "حساب کاربری معلق شده است", "سایت مسدود شد", "دامنه منقضی شده است", "این دامنه منقضی شده است", "این دامنه برای فروش است", "هاست منقضی شده", "پهنای باند به پایان رسیده است", "در حال تعمیر", "سایت در دست تعمیر است", "سایت در دست ساخت است", "در دست ساخت", "سایت در حال بروزرسانی است", "در حال به روز رسانی هستیم", "به زودی باز می گردیم", "به زودی برمی گردیم", "سایت تعطیل است",
)
NOTICES = (
    "please enable javascript", "please enable javascript to continue", "please enable javascript to view this page", "please enable javascript in your browser", "please turn on javascript", "enable javascript", "enable javascript and cookies to continue", "javascript is required", "javascript required", "javascript must be enabled", "javascript is disabled", "javascript disabled", "javascript is not enabled", "javascript is turned off", "javascript is disabled in your browser", "you need to enable javascript", "you need to enable javascript to run this app", "you must enable javascript", "this app requires javascript", "this site requires javascript", "this page requires javascript", "this website needs javascript", "this site requires javascript and cookies", "this site works only with scripts turned on", "this site works best with javascript", "scripts are disabled", "your browser does not support javascript", "no javascript", "noscript", "loading (noscript)", "we're sorry but this app doesn't work properly without javascript enabled", "it looks like javascript is off", "activate scripts",
    "cookies are required", "please enable cookies", "enable cookies to continue", "cookies are disabled", "your browser has cookies disabled", "cookies must be enabled",
    "loading", "loading...", "loading…", "loading page", "loading, please wait", "please wait", "please wait...", "please wait while we check your browser", "just a moment", "just a moment...", "one moment, please", "one moment please...", "hold on", "redirecting", "redirecting...", "you are being redirected", "you will be redirected", "if you are not redirected click here", "initializing", "processing request",
    "checking your browser", "checking your browser...", "checking your browser before accessing", "checking your browser before accessing example.com", "checking if the site connection is secure", "verifying your browser", "verifying you are human", "verify you are human", "verify that you are human", "human verification", "are you a robot?", "are you human?", "i'm not a robot", "robot check", "bot check", "captcha", "solve the captcha", "complete the security check", "security check", "security check required", "browser check", "browser verification", "attention required!", "attention required! | cloudflare", "ddos protection", "ddos protection by cloudflare", "ddos-guard", "access verification", "one more step", "please complete the security check to access", "unusual traffic from your network", "performance & security by", "ray id",
    "your browser is not supported", "unsupported browser", "browser not supported", "outdated browser", "your browser is out of date", "please update your browser", "please upgrade your browser", "use a modern browser",
    "لطفا جاوا اسکریپت را فعال کنید", "لطفا جاوااسکریپت را فعال کنید", "لطفا جاوا اسکریپت مرورگر خود را فعال کنید", "جاوا اسکریپت را فعال کنید", "جاوا اسکریپت غیرفعال است", "جاوا اسکریپت مرورگر شما غیرفعال است", "برای ادامه جاوا اسکریپت را فعال کنید", "برای مشاهده این صفحه جاوا اسکریپت لازم است", "این سایت به جاوا اسکریپت نیاز دارد", "مرورگر شما از جاوا اسکریپت پشتیبانی نمی کند", "اسکریپت ها غیرفعال هستند",
    "کوکی ها را فعال کنید", "برای ادامه کوکی ها را فعال کنید", "لطفا کوکی مرورگر را فعال کنید", "در حال بارگذاری", "در حال بارگذاری...", "لطفا صبر کنید", "لطفا کمی صبر کنید", "لطفا منتظر بمانید", "چند لحظه صبر کنید", "یک لحظه صبر کنید", "در حال انتقال", "در حال انتقال به صفحه", "در حال بررسی مرورگر", "در حال بررسی مرورگر شما", "در حال بررسی امنیت اتصال", "بررسی امنیتی", "تایید کنید که ربات نیستید", "من ربات نیستم", "آیا شما ربات هستید", "کد امنیتی را وارد کنید", "مرورگر شما پشتیبانی نمی شود", "مرورگر خود را به روز کنید", "مرورگر شما قدیمی است",
)
#: Texts that speak of such things and are content all the same.
MENTIONS = (
    "learn javascript in 00 days", "javascript for beginners", "javascript developer jobs", "templates for invitations", "wordpress themes and hosting", "website design templates", "error correction in translation", "how to fix error 00 on your washing machine", "repair of error e00", "rules of access", "door access control systems", "account manager", "account services", "accounting services", "bank account opening",
    "maintenance of elevators", "maintenance contracts", "building maintenance", "construction company", "construction materials", "road construction", "browser games", "security services", "security cameras and alarms", "security doors", "waiting room furniture", "server racks and cooling", "server installation", "domain registration", "domain names and hosting", "title insurance", "title deeds", "untitled: an exhibition of drawings", "sample sale", "free samples", "test preparation", "blood test laboratory", "driving test", "example contracts", "page turner book shop", "hello kitty toys", "coming soon: new summer collection", "lost and found", "found objects gallery", "room 000", "café 000", "route 000", "gate 000 of the bazaar", "channel 0",
    "نمونه قرارداد", "نمونه کارها", "نمونه سوال", "آموزش جاوا اسکریپت", "دوره جاوا اسکریپت مقدماتی", "قالب وردپرس", "قالب و تمپلیت", "قالب کیک", "رفع خطای پکیج", "تعمیر خطای e0 لباسشویی", "رفع خطا و عیب یابی", "تعمیر و نگهداری آسانسور", "خدمات تعمیر", "ساخت و ساز", "در و پنجره", "امنیت شبکه", "دوربین امنیتی", "سرور و تجهیزات شبکه", "نصب و راه اندازی سرور", "ثبت دامنه", "تست جوش", "آزمایشگاه تست خون", "صدور سند", "کاتالوگ [pdf]", "فرم {pdf}", "[فروش ویژه]", "[جدید]", "#تخفیف", "000% پنبه", "پلاک 000", "(pdf) دانلود کاتالوگ", "{zip} دانلود",
)
#: Ordinary titles of pages, in the words of sites rather than of a corpus.
ORDINARY = (
    "home", "about us", "contact us", "our services", "products", "blog", "news", "faq", "frequently asked questions", "price list", "gallery", "portfolio", "careers", "our team", "branches", "login", "my account", "sign up", "shopping cart", "checkout", "search results", "terms and conditions", "privacy policy", "shipping and returns", "warranty and support", "customer reviews", "today's offers", "buyer's guide", "order online", "site map", "download the catalogue",
    "apartments for rent", "houses for sale", "used cars and trucks", "office supplies", "home appliances", "kitchen equipment", "men's shoes", "women's clothing", "children's toys", "jewellery and watches", "health and beauty", "sports equipment", "garden tools", "pet food", "travel agency", "hotel booking", "car rental", "flower delivery", "cake shop", "restaurant menu", "dental care", "eye clinic", "law firm", "tax advice", "insurance broker", "language school", "music lessons", "driving school", "wedding planner", "carpet cleaning", "air conditioning repair", "electrical contractor", "water pumps", "solar energy", "steel pipes", "building materials", "packaging machines", "export of dried fruit", "history and culture", "science for everyone", "recipes", "weather today", "football results", "book review", "short stories", "travel guide",
    "صفحه اصلی", "خانه", "درباره ما", "تماس با ما", "خدمات ما", "محصولات", "وبلاگ", "اخبار", "سوالات متداول", "لیست قیمت", "گالری", "نمونه کارها", "فرصت های شغلی", "شعبه ها", "ورود به سایت", "ثبت نام", "حساب کاربری من", "سبد خرید شما", "تسویه حساب", "قوانین و مقررات", "حریم خصوصی", "شرایط ارسال", "گارانتی و پشتیبانی", "نظرات مشتریان", "فروش ویژه", "راهنمای خرید", "ثبت سفارش", "قیمت روز", "نقشه سایت", "دانلود کاتالوگ", "اساسنامه", "مجوزها",
    "خرید و فروش آپارتمان", "اجاره خانه", "خودروهای کارکرده", "لوازم اداری", "لوازم خانگی", "تجهیزات آشپزخانه", "کفش مردانه", "لباس زنانه", "اسباب بازی کودک", "طلا و جواهر", "لوازم آرایشی و بهداشتی", "لوازم ورزشی", "ابزار باغبانی", "آژانس مسافرتی", "رزرو هتل", "اجاره خودرو", "گل فروشی", "شیرینی و کیک", "منوی رستوران", "دندانپزشکی", "کلینیک چشم", "وکیل پایه یک", "مشاوره مالیاتی", "بیمه عمر", "آموزشگاه زبان", "آموزش موسیقی", "آموزشگاه رانندگی", "تشریفات عروسی", "قالیشویی", "تعمیر کولر", "برق کاری ساختمان", "نقاشی و دکوراسیون", "پمپ آب", "انرژی خورشیدی", "لوله و اتصالات", "مصالح ساختمانی", "ماشین آلات بسته بندی", "صادرات خشکبار", "تاریخ و فرهنگ", "دانستنی های علمی", "آشپزی", "آب و هوا", "نتایج فوتبال", "معرفی کتاب", "داستان کوتاه", "کاشت ناخن و مو", "سمپاشی و ضدعفونی",
)

#: Between texts, so that none begins in the context of another.
_GAP = "\n" * (ORDER - 1)


def joined(pieces: list[str]) -> str:
    return _GAP.join(["", *pieces, ""])


_NORMAL = str.maketrans({**{c: "0" for c in "123456789۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩"}, "ي": "ی", "ك": "ک", "‌": " ", "“": '"', "”": '"', "\n": " "})


_HOST = re.compile(r"(?:https?://)?(?<![\w.$])[\w-]+(?:\.[\w-]+)*\.(?:ir|com|org|net|info|co|io|shop|example|test)(?:/\S*)?(?![\w.])")


def normal(text: str) -> str:
    """Lower case, every digit 0, host names alike, one kind of yeh and kaf, single spaces."""
    return " ".join(_HOST.sub("host", text.translate(_NORMAL).lower()).split())


def _buckets(text: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Buckets of every character with 0..ORDER-1 characters before it, and of those contexts."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    padded = np.concatenate([np.full(ORDER - 1, 10, np.uint32), c])
    grams, contexts = [], []
    h = np.zeros(len(c), np.uint32)
    for n in range(ORDER):
        contexts.append(((h * np.uint32(0x9E3779B1) + np.uint32(7919 * n + 1)) * np.uint32(2246822519)) >> np.uint32(32 - BITS))
        g = (h ^ (c * np.uint32(2654435761))) * np.uint32(3266489917) + np.uint32(104729 * (n + 1))
        grams.append(((g ^ (g >> np.uint32(15))) * np.uint32(668265263)) >> np.uint32(32 - BITS))
        back = padded[ORDER - 2 - n : len(padded) - 1 - n] if n < ORDER - 1 else None
        if back is not None:
            h = (h * np.uint32(31) + back * np.uint32(2654435761)) ^ (h >> np.uint32(9))
    return grams, contexts


def counts(text: str) -> np.ndarray:
    """(2, 2**BITS) counts of grams and of contexts of a text of many lines."""
    grams, contexts = _buckets(text)
    size = 1 << BITS
    return np.stack([np.bincount(np.concatenate(x), minlength=size) for x in (grams, contexts)]).astype(np.float32)


def log_probability(text: str, table: np.ndarray, pull: float = PULL) -> np.ndarray:
    """Log-probability of each character after those before it, orders interpolated."""
    grams, contexts = _buckets(text)
    p = np.full(len(grams[0]), 1 / 400.0)
    for g, c in zip(grams, contexts):
        seen, before = table[0][g], table[1][c]
        p = (np.minimum(seen, before) + pull * p) / (before + pull)
    return np.log(p)


def examples() -> list[list[str]]:
    """The examples of each residue model as they count."""
    weighed = lambda texts: [normal(t) for t in texts for _ in range(WEIGHT)]
    return [[normal(p) for p in PLACEHOLDERS], 20 * weighed(UNSET) + weighed(FILLER), weighed(ERRORS), weighed(NOTICES)]


def residue_tables() -> list[np.ndarray]:
    return [counts(joined(texts)) for texts in examples()]


#: What is left of a part whose characters were lost.
_LOST = re.compile(r"[?\ufffd\s.,!'()-]+")
_PARTS = re.compile(r"\s*[|•«»]\s*|\s+[-–—]\s+")


def parts(text: object) -> list[str]:
    """The parts of a title, restored and normalised, without those lost altogether; each is judged on its own."""
    return [p for p in _PARTS.split(normal(repaired(text))) if p and not _LOST.fullmatch(p)] if isinstance(text, str) else []


def _spans(pieces: list[str]) -> tuple[str, np.ndarray]:
    """The parts as lines of one text, and where each begins."""
    return joined(pieces), np.concatenate([[0], np.cumsum([len(p) + len(_GAP) for p in pieces])]).astype(np.int64) + len(_GAP)


def _ratios(pieces: list[str], tables: list[np.ndarray], natural: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each part begins in the text of all, and summed log-likelihood ratios of each residue model to natural prose."""
    text, at = _spans(pieces)
    base = log_probability(text, natural, NATURAL_PULL)
    return at, [np.concatenate([[0], np.cumsum(np.clip(log_probability(text, t) - base, -6.0, 6.0))]) for t in tables]


def not_clearly(pieces: list[str], tables: list[np.ndarray], natural: np.ndarray) -> list[str]:
    """The parts that no residue model explains better by far."""
    if not pieces:
        return []
    at, sums = _ratios(pieces, tables, natural)
    best = np.max([s[at[1:] - len(_GAP)] - s[at[:-1]] for s in sums], axis=0)
    return [p for p, r in zip(pieces, best) if r < min(CLEARLY, CLEARLY_EACH * len(p))]


def judged(texts: list[str], tables: list[np.ndarray], natural: np.ndarray) -> list[tuple[float, float, int]]:
    """(best ratio, its cover of the part, model) of each text; (0, 0, -1) without a likely window."""
    cut = [parts(t) for t in texts]
    pieces = [p for c in cut for p in c]
    if not pieces:
        return [(0.0, 0.0, -1)] * len(cut)
    at, sums = _ratios(pieces, tables, natural)
    scored = []
    for a, b in zip(at[:-1].tolist(), (at[1:] - len(_GAP)).tolist()):
        best = (0.0, 0.0, -1)
        for k, total in enumerate(sums):
            s = total[a : b + 1]
            low = np.minimum.accumulate(s)
            end = int((s - low).argmax())
            ratio = float(s[end] - low[end])
            whole = float(s[-1] - s[0])  # the part as a whole may be likely enough, if less than its likeliest window
            if ratio >= LEAST_RATIO or whole >= LEAST_WHOLE:
                start = int(s[: end + 1].argmin())
                cover = 1.0 if whole >= LEAST_WHOLE else (end - start) / (b - a)
                best = max(best, (ratio, cover, k), key=lambda x: (x[1] >= LEAST_COVER, x[0]))
        scored.append(best)
    out, i = [], 0
    for c in cut:
        out.append(max(scored[i : i + len(c)], key=lambda x: (x[1] >= LEAST_COVER, x[0]), default=(0.0, 0.0, -1)))
        i += len(c)
    return out


def _counted(texts: DataFrame, pieces) -> np.ndarray:
    """Counts over all texts(t), cut by ``pieces``: reduced split by split, then summed by bucket."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 1 << BITS), np.float32)
        for pdf in batches:
            for i in range(0, len(pdf), 500):
                total += counts(joined(pieces(pdf["t"].iloc[i : i + 500].tolist())))
        kind, bucket = np.nonzero(total)
        yield pd.DataFrame({"kind": kind.astype(np.int32), "bucket": bucket.astype(np.int32), "n": total[kind, bucket].astype(np.float64)})

    rows = spread(texts.filter("t is not null")).mapInPandas(count, "kind int, bucket int, n double")
    summed = rows.groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most 2 x 2**BITS rows
    table = np.zeros((2, 1 << BITS), np.float32)
    table[summed["kind"].to_numpy(), summed["bucket"].to_numpy()] = summed["n"].to_numpy().astype(np.float32)
    return table


def scaled(table: np.ndarray, mass: float) -> np.ndarray:
    """Counts brought down to so many characters, if there are more."""
    return table * np.float32(min(1.0, mass * ORDER / max(float(table[0].sum()), 1.0)))


def natural_table(texts: DataFrame, column: str, tables: list[np.ndarray], prose: Column | None = None, corpus: DataFrame | None = None) -> np.ndarray:
    """Counts of natural prose: a corpus, ordinary titles and mentions, and all texts of a column but residue."""
    base = counts(joined([normal(t) for t in (*ORDINARY, *MENTIONS) for _ in range(WEIGHT)]))
    if corpus is not None:
        # lines without a letter (numbers, times) aren't prose
        base = base + scaled(_counted(corpus.select(F.regexp_replace(prose, r"(?m)^[\d\s:,.>-]*$", "").alias("t")), lambda ts: [normal(t) for t in ts]), CORPUS_MASS)
    own = _counted(texts.select(F.col(column).cast("string").alias("t")), lambda ts: not_clearly([p for t in ts for p in parts(t)], tables, base))
    return base + scaled(own, TITLE_MASS)


def residue(df: DataFrame, id_col: str = "id", column: str = "title", corpus: DataFrame | None = None, corpus_col: str = "text") -> DataFrame:
    """(id, ratio, cover, model) of the rows whose text is residue, wholly or in a part; ``corpus``: texts to know natural prose by."""
    tables = residue_tables()
    natural = natural_table(df, column, tables, F.col(corpus_col), corpus)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = judged(pdf["t"].tolist(), tables, natural)
            out = pd.DataFrame(found, columns=["ratio", "cover", "model"])
            out.insert(0, "id", pdf["id"].to_numpy())
            yield out[out["cover"] >= LEAST_COVER]

    narrow = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(column).cast("string").alias("t")).filter("t is not null")
    return spread(narrow).mapInPandas(judge, "id bigint, ratio double, cover double, model int")
