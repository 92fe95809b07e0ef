"""Filters, relevance and categories of prompt and response pairs; each filter names the first reason that refuses.

Texts are squeezed. Patterns that ignore case are matched on ``plain`` texts: lower case, dotted and dotless i alike.
All patterns are in the common subset of Java and RE2, so that SQL checks use them as they are; where a word must stand
alone, ``whole`` adds its borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import casefold, first_reason, squeeze, squeeze_ends, stripped_lines

_W = r"\p{L}\p{N}_"


def _i(pattern: str) -> str:
    return pattern.replace("ı", "i")


def whole(pattern: str) -> str:
    """``pattern`` where neither a letter nor a digit nor an underscore stands before or after it."""
    return _i(f"(?:^|[^{_W}])(?:{pattern})(?:[^{_W}]|$)")


# Patterns of the filters, on plain texts.
URL = r"https?://|www\."
EMAIL = rf"(?:^|[^{_W}])[a-z0-9_][a-z0-9._%+-]*@[a-z0-9.-]+\.[a-z]{{2,}}(?:[^{_W}]|$)"
PHONE = whole(r"(?:\+?[0-9]{1,3}[ \n.-]?)?(?:\(?[0-9]{3}\)?[ \n.-]?)?[0-9]{3}[ \n.-]?[0-9]{4}")
SECRET = r"(?:api[_-]?key|secret|token|password|passwd|bearer)[ \n]*[:=][ \n]*['\"]?[a-z0-9_\-./+=]{12,}"
KEY_LIKE = rf"(?:^|[^{_W}])(?:sk-[A-Za-z0-9]{{20,}}|hf_[A-Za-z0-9]{{20,}}|ghp_[A-Za-z0-9]{{20,}}|AKIA[0-9A-Z]{{16}})(?:[^{_W}]|$)"
IDENTITY = "chatgpt|openai|as an ai language model"
BROKEN = "[ÃÄÅÐð�]"
ADULT = whole("porno|pornografi|erotik|çıplak|cinsel içerik")
HATE = whole("ırkçı|irkci|nefret söylemi|aşağılayıcı|asagilayici hakaret")
UNSAFE = whole("bomba yap|silah yap|uyuşturucu üret|uyusturucu uret|hackle|çalınmış şifre|calinmis sifre")

# Fixed values of the first instruct filter.
TURKISH_LETTERS = "[çğıöşüÇĞİÖŞÜ]"
TURKISH_WORDS = ("ve", "bir", "bu", "için", "nedir", "nasıl", "olarak", "ile", "çok", "daha", "kısa", "açıkla", "örnek", "yardım", "model", "veri", "kod")
BAD_IDENTITY = ("ben chatgpt", "chatgpt olarak", "openai tarafından geliştirildim", "openai tarafindan gelistirildim", "openai geliştirdi", "openai gelistirdi", "as an ai language model")
BAD_TOPICS = ("porn", "porno", "seks", "çıplak", "erotik", "bomba yap", "silah yap", "uyuşturucu", "nefret", "ırkçı", "öldür", "intihar yöntemi")
INSTRUCT_SECRETS = "|".join((URL, rf"[{_W}.+-]+@[{_W}.-]+\.[a-z]{{2,}}", whole(r"(?:\+?[0-9][ \n().-]*){8,}\+?[0-9]"), whole("api[_-]?key|secret|token|password|passwd|bearer"), whole("sk-[a-z0-9]{16,}|ghp_[a-z0-9]{20,}")))
INSTRUCT_CATEGORIES = (
    ("identity", ("kimsin", "chatgpt", "openai", "kim geliştirdi", "kendini tanıt", "hangi model")),
    ("programming", ("python", "kod", "api", "backend", "frontend", "docker", "git", "sql", "json", "terminal", "programlama")),
    ("ai", ("yapay zeka", "model", "token", "llm", "transformer", "fine-tuning", "öğrenmesi", "loss", "veri seti")),
    ("emotional_support", ("kötü hissediyorum", "motivasyon", "stres", "moral", "kaygı", "yalnız", "zorlanıyorum", "yorgun")),
    ("career", ("kariyer", "öğren", "çalışma plan", "staj", "mülakat", "cv", "portfolyo", "study")),
    ("explanation", ("kısaca", "basitçe", "örnek", "özet", "maddelerle", "açıkla")),
    ("general", ("türkiye", "istanbul", "üniversite", "bilim", "internet", "tarih", "coğrafya")),
)

# Signs of software questions.
_X = rf"[{_W}]*"
SOFTWARE_STRONG = whole(
    "|".join(
        [
            "python['’]?d[ae]", "python ile", "python kullanarak", r"git[ \n]+(?:commit|branch|push|pull|clone|merge|rebase|status|log)", r"(?:commit|branch|push|pull|clone|merge|rebase)[ \n]+git",
            r"rest[ \n]+api", r"api[ \n]+rest", "docker", "github", "api", "http", "json", "sql", "backend", "frontend", "c#", r"\.net", "javascript", "typescript", "terminal", "error", "exception", "debugging", "debug", "linux",
            "virtual environment", "pip", "npm", "controller", "dto", "entity framework", "authentication", "jwt", "endpoint", "pytorch", "cuda", "tokenizer", "checkpoint", "validation loss", "model eğitimi", "model egitimi",
            "llm training", f"yazılım{_X}", f"programlama{_X}", f"programc[ıi]{_X}",
        ]
    )
)
SOFTWARE_WEAK = whole("python|git|rest|database|package|dependency|service|server|client|request|response") + _i("|veritaban[ıi]|hata")
SOFTWARE_CONTEXT = whole("|".join([f"kod{_X}", f"programlama{_X}", f"yazılım{_X}", f"uygulama{_X}", "script", f"komut{_X}", "terminal", f"fonksiyon{_X}", f"sınıf{_X}", f"metot{_X}", f"değişken{_X}", f"degisken{_X}", f"algoritma{_X}", f"repo{_X}", "repository", f"derle{_X}", "compile", "runtime", "framework"]))
SOFTWARE_FALSE = "monty python|python ve kutsal kase|" + whole("trna|mrna") + "|amino asit|protein sentezi|ribozom|genetik kod"

# Signs of support questions and of tasks that only look like them.
SUPPORT_PROMPT = _i(
    "kendimi .{0,30}(?:kötü|kotu|yetersiz|yalnız|yalniz|mutsuz|üzgün|uzgun)|moralim .{0,30}(?:bozuk|düşük|dusuk)|"
    rf"motivasyon{_X} .{{0,30}}(?:düştü|dustu|azaldı|azaldi|yok)|çok yoruldum|cok yoruldum|tükendim|tukendim|devam edemiyorum|odaklanamıyorum|odaklanamiyorum|"
    "iş bulamıyorum|is bulamiyorum|işsiz|issiz|projem .{0,40}(?:ilerlemiyor|takıldı|takildi)|başarısız hissediyorum|basarisiz hissediyorum|başaramıyorum|basaramiyorum|"
    "kaygılıyım|kaygiliyim|endişeliyim|endiseliyim|stresliyim|hata aldıkça|hata aldikca|kod yazarken .{0,30}takılıyorum|takiliyorum|kendime güvenim|kendime guvenim|hiçbir şey yapasım yok|hicbir sey yapasim yok|"
    "bunaldım|bunaldim|panikliyorum|geriliyorum|başlayamıyorum|baslayamiyorum|geride hissediyorum|ağır geliyor|agir geliyor|toparlanmakta zorlanıyorum|zorlanıyorum|bitiremeyecekmişim|bitiremeyecekmisim|yapamıyorum|yapamiyorum|ne yapmalıyım|ne yapmaliyim"
)
SUPPORT_RESPONSE = _i(
    "küçük bir adım|kucuk bir adim|bir sonraki adım|bir sonraki adim|küçük bir görev|kucuk bir gorev|hedefi küçült|hedefi kucult|tek adım|tek adim|zamanlayıcı|zamanlayici|küçük başlangıç|kucuk baslangic|yeterli olabilir|yan yana yaz|bir cümleyle|bir cumleyle|"
    "bugün sadece|bugun sadece|bugün yalnızca|bugun yalnizca|nefes|mola|dinlen|not al|plan yap|parçalara böl|parcalara bol|yalnız değilsin|yalniz degilsin|zor olabilir|anlaşılır|anlasilir|güvendiğin biri|guvendigin biri|destek almak"
)
SELF_HARM = whole("intihar|kendime zarar|kendimi öldür|kendimi oldur|yaşamak istemiyorum|yasamak istemiyorum")
VIOLENCE = whole("infaz|bıçak|bicak|silah|öldür|oldur|yarala|şiddet|siddet|protesto|nefret")
MEDICAL = whole("teşhis|teshis|tedavi ederim|terapi veririm|doktor yerine|ilaç kullan|ilac kullan")
TASK_NOISE = whole("çevir|cevir|türkçeye|turkceye|ingilizceye|rumence|çekçe|cekce|seçenekler|secenekler|çoktan seçmeli|coktan secmeli|inceleme|özet|ozet|aynı anlama|ayni anlama|diyalog|makale|doğru mu|dogru mu|ürün incelemesi|urun incelemesi") + _i(rf"|(?:^|[^{_W}])(?:soru:|bağlam:|baglam:)[{_W}]")

# Fixed values of the mix filter.
MIX_SECRETS = "|".join((URL, EMAIL, PHONE, SECRET))
MIX_UNSAFE = whole("porno|pornografi|erotik|çıplak|cinsel içerik|bomba yap|silah yap|uyuşturucu üret|uyusturucu uret|çalınmış şifre|calinmis sifre|intihar yöntemi|kendime zarar yöntemi|kendimi öldürme")
MIX_IDENTITY = whole("chatgpt|openai") + "|as an ai language model|developed by openai|trained by openai"
MIX_AI = whole("yapay zeka|yapay zekâ|dil modeli|llm|tokenizer|transformer|attention|checkpoint|validation loss|model eğitimi|model egitimi|pytorch|cuda|fine-?tuning|embedding")
MIX_LOCAL_AI = whole("pytorch|cuda|jsonl|tokenizer|checkpoint|dataset cleaning|dataset temizleme|veri temizleme|veri seti temizleme")
MIX_SOFTWARE = whole("python|docker|github|api|http|json|sql|backend|frontend|javascript|typescript|terminal|error|exception|debug|debugging|linux|pip|npm|controller|dto|authentication|jwt|endpoint|pytorch|cuda|tokenizer|checkpoint|jsonl|dataset cleaning|dataset temizleme|veri temizleme|programlama|yazılım|yazilim") + r"|\.net|c#|entity framework"
_GAP = rf"(?:[^{_W}\n](?:.*[^{_W}\n])?)"
MIX_FALSE = SOFTWARE_FALSE + "|hava liman.*terminal|terminal.*hava liman|" + whole(f"pip{_GAP}kar|kar{_GAP}pip") + rf"|ticaret.*[^{_W}\n]pip(?:[^{_W}]|$)|programlama hedef"
MIX_NOISE = _i(
    "ürün incelemesi|urun incelemesi|olumlu veya olumlu|olumsuz veya olumlu|hangi dil|çevir|cevir|başlık yaz|baslik yaz|makalenin.*özeti|makalenin.*ozeti|bu metin ne hakkında|bu metin ne hakkinda|konuyu seç|konuyu sec|"
    "seçenekler|secenekler|seçenek:|secenek:|cevabınızı seçin|cevabinizi secin|çoktan seçmeli|coktan secmeli|önceki metin göz önüne|onceki metin goz onune|takip ediyor mu|duygusu nedir|tonu var mı|tonu var mi|diyaloğu.*özet|diyalogu.*ozet|"
    "kelimeleri bölümlere ayır|kelimeleri bolumlere ayir|bu karakterleri kullanan bir cümle|bu karakterleri kullanan bir cumle|karakterleri kullanarak.*cümle|karakterleri kullanarak.*cumle|iyi bir başlık|iyi bir baslik|başlık nedir|baslik nedir|"
    "ispanyolca kullanarak söyle|ispanyolca kullanarak soyle|almanca mı|almanca mi|fransızca kullanarak söyle|fransizca kullanarak soyle|rumenceye mi|müşterinin.*yorum|musterinin.*yorum|memnun olduğunu mu|memnun oldugunu mu|"
    "dosya uzant|dosyanızın açılmaması|dosyanizin acilmamasi|dosyanızı açmanın|dosyanizi acmanin|noktalama işaret|noktalama isaret|boşluklar eksik|bosluklar eksik|hepsi küçük harf|hepsi kucuk harf|büyük/küçük harf|buyuk/kucuk harf|paylaşılan yazılım|paylasilan yazilim"
)
MIX_SUPPORT_PROMPT = _i(
    "kendimi .{0,30}(?:kötü|kotu|yetersiz|yalnız|yalniz|mutsuz|üzgün|uzgun)|moralim .{0,30}(?:bozuk|düşük|dusuk)|motivasyon|çok yoruldum|cok yoruldum|tükendim|tukendim|devam edemiyorum|odaklanamıyorum|odaklanamiyorum|"
    "iş bulamıyorum|is bulamiyorum|projem .{0,40}(?:ilerlemiyor|takıldı|takildi)|kaygılıyım|kaygiliyim|endişeliyim|endiseliyim|stresliyim|hata aldıkça|hata aldikca|kendime güvenim|kendime guvenim"
)
MIX_SUPPORT_RESPONSE = _i("küçük|kucuk|mola|nefes|not al|plan yap|parçalara böl|parcalara bol|yalnız değilsin|yalniz degilsin|zor olabilir|anlaşılır|anlasilir|destek")
MIX_SUPPORT_NOISE = _i("çevir|cevir|türkçeye|turkceye|ingilizceye|seçenekler|secenekler|çoktan seçmeli|coktan secmeli|soru:|bağlam:|baglam:|inceleme|özet|ozet|aynı anlama|ayni anlama|diyalog|makale|doğru mu|dogru mu")
LOCAL_IDENTITY = ("local_identity", "local_identity_anchor")
PREFERRED = _i(
    "python|docker|git commit|git branch|git push|git pull|github|api|rest|http|json|sql|database|veritabanı|veritabani|backend|frontend|javascript|typescript|terminal error|terminal hatası|debug|debugging|exception|pip install|npm|controller|service|dto|entity framework|authentication|"
    "jwt|endpoint|server|client|request|response|pytorch|cuda|jsonl|tokenizer|checkpoint|dataset cleaning|dataset temizleme|veri temizleme|yazılım|yazilim|programlama|programcı|programci|dosya uzantısı|dosya uzantisi|anahtar.?değer|anahtar.?deger|sözlük|sozluk|veri formu|veri yapısı|veri yapisi"
)
CODE_SIGNS = r"```|\{.*:.*\}|" + whole("def|class|import")
PROMPT_ERRORS, PROMPT_TOOLS, PROMPT_FOOD = whole("hata|error|exception|debug|terminal"), whole("json|sql|api|python|docker|git"), whole("restoran|kahve dükkanı|müşteri puanı|eattype|yiyecek")

# Fixed values of the distillation filter.
DISTILL_IDENTITY = whole("ben +chatgpt|i +am +chatgpt") + "|openai +tarafindan +geli[şs]tirildim|i +was +developed +by +openai|developed +by +openai|as an ai language model"
DISTILL_OTHER = whole("ben +qwen|i +am +qwen|qwen['’]?im")
DISTILL_PRIVATE = EMAIL + "|" + PHONE
DISTILL_CYBER = _i("phishing|keylogger|ransomware|credential theft|steal password|şifre çal|sifre cal|exploit yaz|zararlı yazılım|zararli yazilim|sql injection ile saldır|ddos")
DISTILL_ILLEGAL = "sahte kimlik|uyuşturucu üret|uyusturucu uret|bomba yap|silah yap"
DISTILL_MEDICAL = _i("tanı koy|teşhis|tedavi planı|terapi yerine|psikolog yerine|medical diagnosis|diagnose you|therapy replacement|intihar yöntemi|kendine zarar verme yöntemi|self-harm method|how to harm yourself")

# What generated code must not hold.
UNSAFE_CODE = (
    ("del /s", r"del /s"), ("format c:", r"format c:"), ("os.remove", r"os\.remove"), ("shutil.rmtree", r"shutil\.rmtree"), ("subprocess", whole("subprocess")), ("eval(", r"eval\("), ("exec(", r"exec\("), ("requests.post", r"requests\.post"),
    ("token", whole("token")), ("password", whole("password")), ("credential", whole("credential")),
)


# Fixed values of the example score: terms, phrases of web furniture, marks of turns, and what refuses at once.
SCORE_TECHNICAL = ("python", "fonksiyon", "liste", "sözlük", "json", "pathlib", "try", "except", "class", "tokenizer", "cuda", "pytorch", "torch", "transformer", "checkpoint", "corpus", "eval", "model", "dataset", "veri", "git")
SCORE_PROJECT = ("tokenizer", "cuda", "pytorch", "python", "transformer", "checkpoint", "corpus", "eval", "pipeline", "dataset")
SCORE_FURNITURE = ("cookie", "cookies", "privacy policy", "gizlilik politikası", "login", "log in", "sign in", "subscribe", "newsletter", "reklam", "advertisement", "terms of service", "kullanım şartları")
SCORE_WORDS = ("ve", "bir", "için", "nasıl", "nedir", "neden", "kullanılır", "örnek", "hata", "değer", "metin")
USER_MARK, ANSWER_MARK = "Kullanıcı:", "Asistan:"
HARD_NEGATIVES = ("too short", "too long", "broken code fences", "too many URLs", "web boilerplate", "empty answer", "answer repeats question")


def plain(c: Column) -> Column:
    """Lower case with all kinds of i alike, as patterns that ignore case take them."""
    return F.lower(F.translate(c, "İIı", "iii"))


def tidy(c: Column) -> Column:
    """Text of an instruct row: entities, tags and zero-width spaces go, white space is squeezed. Null is empty."""
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return squeeze(F.replace(F.regexp_replace(c, "<[^>]+>", " "), F.lit("​"), F.lit(" ")))


def texts(prompt: Column, response: Column, *more: Column) -> dict[str, Column]:
    """Columns that the filters read: p and r squeezed, their plain forms fp and fr, t = both, ft, and ``row``, the plain
    text of all given columns. They are columns of their own, so each is computed once a row."""
    return {"p": squeeze(prompt), "r": squeeze(response), "row": plain(F.concat_ws("\n", prompt, response, *more))}


def with_texts(df, prompt: str = "prompt", response: str = "response", more: tuple[str, ...] = ()):
    """``df`` with the columns of ``texts``."""
    out = df.withColumns(texts(F.col(prompt), F.col(response), *[F.col(m) for m in more]))
    out = out.withColumns({"t": F.concat("p", F.lit("\n"), "r"), "fp": plain(F.col("p")), "fr": plain(F.col("r"))})
    return out.withColumn("ft", F.concat("fp", F.lit("\n"), "fr"))


def _sized(least: int, most: int, prompt: int, prompt_first: bool) -> list[tuple[str, Column]]:
    n, m = F.length("r"), F.length("p")
    sizes = [("response_too_short", n < least), ("response_too_long", n > most)]
    return [("empty_prompt", F.col("p") == ""), ("empty_response", F.col("r") == ""), *([("prompt_too_long", m > prompt)] * prompt_first), *sizes, *([("prompt_too_long", m > prompt)] * (not prompt_first))]


def _has(c: str, pattern: str) -> Column:
    return F.col(c).rlike(pattern)


def chat_reason() -> Column:
    """First reason of the conversation filter: 20 to 800 characters, prompts to 500."""
    return first_reason(*_sized(20, 800, 500, False), ("blocked_identity_phrase", _has("row", IDENTITY)), ("url", _has("ft", URL)), ("email", _has("ft", EMAIL)), ("phone", _has("ft", PHONE)), ("secret_or_api_key", _has("ft", SECRET) | _has("t", KEY_LIKE)))


def turkish(p: str = "fp", r: str = "fr", t: str = "t") -> Column:
    """Whether a pair looks Turkish: a letter of its own, or three different frequent words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(t)), F.lit("[a-zçğıöşü]+"), F.lit(0)))
    return _has(t, TURKISH_LETTERS) | (F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in TURKISH_WORDS]))) >= 3)


def special_share(c: str) -> Column:
    """Share of characters that are no letter, digit, space or common mark."""
    return F.length(F.regexp_replace(c, r"[\p{L}\p{N}\s.,:;!?\-_'\"()\[\]/%]+", "")) / F.length(c)


def instruct_reason(least: int = 20, most: int = 800, prompt: int = 500) -> Column:
    """First reason of the instruct filter, over ``tidy`` texts."""
    low = F.lower("t")
    blocked = _any_of(low, BAD_IDENTITY) | _any_of(low, BAD_TOPICS) | low.rlike(INSTRUCT_SECRETS)
    return first_reason(
        ("empty", (F.col("p") == "") | (F.col("r") == "")), ("prompt_too_long", F.length("p") > prompt), ("response_length", ~F.length("r").between(least, most)), ("not_turkish", ~turkish()), ("blocked_content", blocked),
        ("special_characters", (special_share("p") > 0.18) | (special_share("r") > 0.18)), ("few_words", F.size(F.split("r", " ")) < 3),
    )


def _any_of(c: Column, terms) -> Column:
    found = F.lit(False)
    for t in terms:
        found = found | F.contains(c, F.lit(t))
    return found


def instruct_category(own: tuple[str, ...] = ()) -> Column:
    """Category of a pair by keywords, first match wins; ``own``: further names of the model that mean identity."""
    low = F.lower(F.concat(F.lit(" "), "p", F.lit(" "), "r", F.lit(" ")))
    return F.coalesce(*[F.when(_any_of(low, terms + own if name == "identity" else terms), name) for name, terms in INSTRUCT_CATEGORIES], F.lit("other"))


def software_related() -> Column:
    return ~_has("ft", SOFTWARE_FALSE) & (_has("ft", SOFTWARE_STRONG) | _has("ft", SOFTWARE_WEAK) & _has("ft", SOFTWARE_CONTEXT))


def name_list(c: str) -> Column:
    """Whether a text lists names: three separators or more, no sentence marks, four parts or more, most of them short."""
    parts = F.filter(F.transform(F.split(c, r"[,;\n•]+"), lambda x: F.btrim(x, F.lit(" -•*0123456789.)("))), lambda x: x != "")
    short = F.filter(parts, lambda x: F.size(F.split(x, " +")) <= 4)
    body = F.btrim(F.col(c), F.lit(" -•*0123456789.,;:\n\t"))
    return (body != "") & (F.length(F.regexp_replace(c, r"[^,;\n•]", "")) >= 3) & ~F.col(c).rlike("[.!?]") & (F.size(parts) >= 4) & (F.size(short) >= 0.85 * F.size(parts))


def software_reason() -> Column:
    """First reason of the software filter; identity and secrets are looked for in the whole row."""
    return first_reason(
        *_sized(20, 1000, 600, False), ("blocked_identity_phrase", _has("row", IDENTITY)), ("url", _has("row", URL)), ("email", _has("row", EMAIL)), ("phone", _has("row", PHONE)), ("secret_or_api_key", _has("row", SECRET) | _has("t", KEY_LIKE)),
        ("adult_content", _has("ft", ADULT)), ("hate_or_harassment", _has("ft", HATE)), ("illegal_or_unsafe", _has("ft", UNSAFE)), ("name_list", name_list("p") | name_list("r")), ("broken_turkish", _has("t", BROKEN)), ("not_software_related", ~software_related()),
    )


def support_reason(local: bool = False) -> Column:
    """First reason of the support filter; ``local`` for written seeds, which need no signs of support."""
    where = "ft" if local else "row"
    noise = [] if local else [("task_noise", _has("fp", TASK_NOISE))]
    related = [] if local else [("not_support_related", ~(_has("fp", SUPPORT_PROMPT) & _has("fr", SUPPORT_RESPONSE)))]
    return first_reason(
        *_sized(20, 700, 500, True), ("blocked_identity_phrase", _has(where, IDENTITY)), *noise, ("self_harm_skipped", _has("ft", SELF_HARM)), ("violent_or_hate_context", _has("ft", VIOLENCE)), ("medical_or_therapy_claim", _has("ft", MEDICAL)),
        ("url", _has(where, URL)), ("email", _has(where, EMAIL)), ("phone", _has(where, PHONE)), ("secret_or_api_key", _has(where, SECRET)), ("broken_turkish", _has("t", BROKEN)), *related,
    )


def mix_category() -> Column:
    """Category by declared category, source and signs, in this order."""
    c, s = F.coalesce("category", F.lit("general")), F.coalesce("source", F.lit(""))
    return (
        F.when((c == "identity") | s.isin(*LOCAL_IDENTITY), "identity").when((c == "emotional_support") | (s == "local_support_seed"), "emotional_support")
        .when((s == "local_ai_seed") & _has("ft", MIX_LOCAL_AI), "programming").when((c == "ai") | (s == "local_ai_seed") | _has("ft", MIX_AI), "ai").when((c == "programming") | _has("ft", MIX_SOFTWARE), "programming").otherwise("general")
    )


def identity_contaminated(own: str) -> Column:
    """Whether a pair claims another model's identity. A local identity row may name other models to deny them."""
    excepted = F.coalesce("source", F.lit("")).isin(*LOCAL_IDENTITY) & _has("fp", "chatgpt|openai|gpt") & _has("fr", _i("hayır|değilim|degilim")) & F.contains("fr", F.lit(own))
    return F.when(excepted, _has("fr", "ben chatgpt|i am chatgpt")).otherwise(_has("ft", MIX_IDENTITY))


def programming_score() -> Column:
    """Three for each preferred word, bonuses for code and for prompts on errors and tools, malus for restaurant tasks."""
    n = F.regexp_count("ft", F.lit(rf"(?<![{_W}])(?:{PREFERRED})(?![{_W}])"))
    one = lambda c: c.cast("int")
    return 3 * n + 4 * one(_has("ft", CODE_SIGNS)) + 3 * one(_has("fp", PROMPT_ERRORS)) + 3 * one(_has("fp", PROMPT_TOOLS)) - 2 * one(_has("fp", PROMPT_FOOD))


def mix_reason(own: str) -> Column:
    """First reason of the mix filter; needs ``kind``, the category by ``mix_category``."""
    code, support = F.col("kind") == "programming", (F.col("kind") == "emotional_support") & (F.coalesce("source", F.lit("")) != "local_support_seed")
    return first_reason(
        ("empty_prompt", F.col("p") == ""), ("empty_response", F.col("r") == ""), ("prompt_too_long", F.length("p") > 700), ("response_too_short", F.length("r") < 20), ("response_too_long", F.length("r") > 1200), ("broken_turkish", _has("t", BROKEN)),
        ("blocked_identity_phrase", identity_contaminated(own)), ("secret_or_private_data", _has("ft", MIX_SECRETS) | _has("t", KEY_LIKE)), ("unsafe_content", _has("ft", MIX_UNSAFE)),
        ("software_false_positive", code & (_has("ft", MIX_FALSE) | F.contains("ft", F.lit("terminal")) & F.contains("ft", F.lit("uçak")))), ("software_task_noise", code & _has("fp", MIX_NOISE)), ("not_programming_related", code & ~_has("ft", MIX_SOFTWARE)),
        ("weak_programming_signal", code & (programming_score() <= 0)), ("support_task_noise", support & _has("fp", MIX_SUPPORT_NOISE)), ("not_support_related", support & ~(_has("fp", MIX_SUPPORT_PROMPT) & _has("fr", MIX_SUPPORT_RESPONSE))),
    )


def distill_reason(own: str) -> Column:
    """First reason of the distillation filter; ``own`` is the model's own name, in plain form, which only identity rows
    may claim."""
    other = F.coalesce("category", F.lit("")) != "identity"
    return first_reason(
        *_sized(20, 900, 1 << 30, False), ("chatgpt_openai_contamination", _has("ft", DISTILL_IDENTITY)), ("qwen_identity_contamination", _has("ft", DISTILL_OTHER)), ("secret_or_token", _has("ft", SECRET) | _has("t", KEY_LIKE)), ("private_data", _has("ft", DISTILL_PRIVATE)),
        ("url_content", _has("ft", URL)), ("unsafe_cyber", _has("ft", DISTILL_CYBER)), ("illegal_instruction", _has("ft", DISTILL_ILLEGAL)), ("medical_or_therapy_claim", _has("ft", DISTILL_MEDICAL)), ("own_identity_leak", other & F.startswith("fr", F.lit(f"ben {own}"))),
    )


def scored_examples(df: DataFrame, id_col: str, text_col: str, valid: Column | None = None, least: int = 20, most: int = 4000, own: tuple[str, ...] = ()) -> DataFrame:
    """(id, score, negatives, accepted): additive score of dialogue examples. An example is accepted from a score of two
    without a negative that refuses at once; of accepted ones with one case-folded text the first, by id, stays and the
    others have the negative ``duplicated exact example`` and no score. ``valid``: whether the example has a short block
    of valid Python (see ``sequences.python_valid``; none by default); ``own``: further terms of the project. Null texts
    count as empty; ids are unique."""
    e = F.coalesce(F.col(text_col), F.lit(""))
    answer = F.when(F.contains(e, F.lit(ANSWER_MARK)), squeeze_ends(F.substr(e, F.instr(e, ANSWER_MARK) + len(ANSWER_MARK)))).otherwise("")
    asked = F.when(F.contains(e, F.lit(USER_MARK)), squeeze_ends(F.substring_index(F.substr(e, F.instr(e, USER_MARK) + len(USER_MARK)), "\n", 1))).otherwise("")
    d = df.select(F.col(id_col).alias("id"), e.alias("e"), casefold(e).alias("f"), answer.alias("a"), F.transform(stripped_lines(e), squeeze).alias("l"), squeeze(casefold(e)).alias("key"), squeeze(casefold(asked)).alias("q"), squeeze(casefold(answer)).alias("fa"), (F.lit(False) if valid is None else valid).alias("v"))
    users = F.regexp_count("e", F.lit(USER_MARK))
    checks = (
        ("too short", F.length("e") < least), ("too long", F.length("e") > most), ("broken code fences", F.regexp_count("e", F.lit("```")) % 2 != 0), ("too many URLs", F.regexp_count("e", F.lit("(?i)https?://|www\\.")) > 2), ("web boilerplate", _any_of(F.col("f"), SCORE_FURNITURE)),
        ("unfinished dialogue", squeeze_ends(F.col("e")).endswith(USER_MARK) | squeeze_ends(F.col("e")).endswith(ANSWER_MARK)), ("repeated lines", F.size("l") - F.size(F.array_distinct("l")) >= 3), ("multiple user markers inside example", users > 1),
        ("empty answer", F.contains("e", F.lit(ANSWER_MARK)) & (F.col("a") == "")), ("answer repeats question", (F.col("q") != "") & (F.col("fa") != "") & F.startswith("fa", F.col("q")) & (F.length("fa") < F.length("q") + 20)),
    )
    d = d.withColumn("negatives", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks])))
    hits = lambda terms: sum((F.contains("f", F.lit(t)).cast("int") for t in terms), F.lit(0))
    local = _has("e", TURKISH_LETTERS) | F.arrays_overlap(F.regexp_extract_all("f", F.lit(rf"[{_W}]+"), F.lit(0)), F.array(*[F.lit(w) for w in SCORE_WORDS]))
    points = 2 * local.cast("int") + F.least(hits(SCORE_TECHNICAL), F.lit(3)) + 2 * ((users > 0) & F.contains("e", F.lit(ANSWER_MARK))).cast("int") + 2 * F.col("v").cast("int") + (F.length("a") >= 20).cast("int") + F.least(hits(SCORE_PROJECT + own), F.lit(2))
    d = d.withColumn("score", (points - 2 * F.size("negatives")).cast("long"))
    d = d.withColumn("ok", (F.col("score") >= 2) & ~F.arrays_overlap("negatives", F.array(*[F.lit(n) for n in HARD_NEGATIVES]))).select("id", "key", "score", "negatives", "ok")
    first = d.where("ok").groupBy("key").agg(F.min("id").alias("first"))
    again = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    return d.join(first, "key", "left").select("id", F.when(again, F.lit(0).cast("long")).otherwise(F.col("score")).alias("score"), F.when(again, F.array(F.lit("duplicated exact example"))).otherwise(F.col("negatives")).alias("negatives"), (F.col("ok") & ~again).alias("accepted"))


def unsafe_code(c: Column) -> Column:
    """Array of (label, hits) of what generated code must not hold, those with hits."""
    low = plain(c)
    count = lambda p: F.size(F.regexp_extract_all(low, F.lit(p), F.lit(0)))
    return F.filter(F.array(*[F.struct(F.lit(label).alias("label"), count(p).alias("hits")) for label, p in UNSAFE_CODE]), lambda x: x["hits"] > 0)
