"""Marks by which questions are read: a rule table (role, label, marker) in order, which callers may replace by their own."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

# Words and stems by which a question's task, action and wanted materials are told, and the labels that they stand for.
SOCIAL = "hi hello hey ok okay thanks thank привет приветик здравствуйте здравствуй добрый доброе день утро вечер спасибо благодарю ок окей ясно".split()
STOPWORDS = (
    "and the for with from about into not как что где куда когда чем сколько если или не ни ли это этот эта эти такое его она оно мне в во на с со из за к ко по про от до у надо делать делаю сделать должен должна должно должны "
    "нужно нужен нужна нужны можно почему какой какая какие какого каком какую кто кого чей чья чье"
).split()
GENERIC = "документ материал источник ответ вопрос шаг шаги пример основные правила частые ошибки ошибка делать действие уход общий обычный обычную предмет вещь это такое растение растения продукт продукты место воды вода".split()
TASKS = {
    "setup": ("install", "setup", "configure", "connect", "deploy", "run", "start", "установ", "настро", "подключ", "запуст", "разверн", "созда"),
    "debug": ("error", "exception", "fail", "fails", "fix", "debug", "не работает", "ошиб", "слом", "исправ", "падает"),
    "explain": ("explain", "overview", "why", "что такое", "объясни", "зачем", "почему", "как работает"),
    "compare": ("compare", "versus", "vs", "difference", "сравн", "отлич", "лучше", "или"),
    "admin": ("admin", "role", "policy", "permission", "access", "rls", "админ", "роль", "права", "доступ", "политик"),
    "source_check": ("source", "citation", "reference", "источник", "цитат", "докаж", "где в материале", "по материал"),
    "visual": ("screenshot", "image", "photo", "vision", "скрин", "изображ", "фото", "картин"),
}
#: The order in which tasks are looked for.
TASK_ORDER = ("source_check", "debug", "compare", "admin", "setup", "visual", "explain")
ENVIRONMENT = "local locally localhost docker compose windows linux macos server cloud port локаль локально сервер облако порт".split()
CONSTRAINTS = "only without must только без обязательно нельзя нужен после перед".split()
ACTIONS = (
    ("install", "установка"), ("setup", "настройка"), ("configure", "настройка"), ("connect", "подключение"), ("deploy", "развертывание"), ("run", "запуск"), ("start", "запуск"), ("установ", "установка"), ("настро", "настройка"), ("подключ", "подключение"),
    ("запуст", "запуск"), ("разверн", "развертывание"), ("полив", "полив"), ("поливат", "полив"), ("ухаж", "уход"), ("хран", "хранение"), ("готов", "готовка"), ("подготов", "подготовка"), ("убор", "уборка"), ("убрат", "уборка"), ("провер", "проверка"),
    ("упаков", "упаковка"), ("упак", "упаковка"), ("полож", "размещение"), ("взять", "сбор"), ("почин", "ремонт"), ("ремонт", "ремонт"), ("отлич", "сравнение"), ("сравн", "сравнение"), ("нельзя", "запрет"), ("должн", "ограничение"),
)
CONTENT_TYPES = {
    "homework_review_rules": ("check homework", "review homework", "homework review", "review rules", "criteria", "rubric", "проверить дз", "проверка дз", "критер", "рубри", "ошибки в дз"),
    "homework_task": ("homework", "assignment", "deliverable", "дз", "домашн", "задани", "сдать", "что нужно сделать"),
    "course_catalog": ("course list", "available courses", "courses are available", "what courses", "какие курсы", "список курсов", "есть курсы", "каталог курсов"),
    "course_structure": ("course structure", "module", "lesson list", "структур", "модул", "урок", "программа курса"),
    "course_terms": ("course terms", "deadline", "access", "услов", "доступ", "срок", "дедлайн", "тариф", "оплат"),
    "student_case": ("student case", "student question", "case", "разбор студента", "вопрос студента", "кейс"),
    "official_docs": ("official", "documentation", "docs", "официальн", "документац", "доки"),
    "external_docs": ("external docs", "release notes", "changelog", "внешн", "изменилось в документации", "релиз"),
    "platform_navigation": ("where click", "which button", "screen", "куда наж", "где кноп", "экран", "интерфейс", "меню"),
    "personal_data": ("my balance", "my account", "сколько у пользователя", "мой баланс", "мои данные", "у пользователя", "личн"),
    "lesson_material": ("install", "setup", "configure", "explain", "lesson", "установ", "настро", "подключ", "объясн", "урок"),
}
TASK_CONTENT = {"setup": ("lesson_material",), "explain": ("lesson_material",), "compare": ("lesson_material",), "debug": ("student_case", "lesson_material"), "admin": ("course_terms", "course_structure"), "visual": ("platform_navigation",)}
OFFICIAL = "official docs documentation официальн документац".split()
DEICTIC = "это this that туда сюда".split()
# End of the fixed values. What follows is this engine's own.
FRESH = "latest newest current today changelog".split()
POINTS = {"setup": ("steps", "how to tell that it works"), "debug": ("cause", "remedy"), "compare": ("differences", "which to choose when"), "admin": ("rights", "steps"), "source_check": ("what the source says",), "visual": ("what is seen",)}

_ORDER = ("task", "action", "content", "task_content", "point")


@dataclass(frozen=True)
class Marks:
    """The table by roles: flat lists, and labelled ones in the order in which they are looked for."""

    social: tuple[str, ...] = ()
    stopword: tuple[str, ...] = ()
    generic: tuple[str, ...] = ()
    environment: tuple[str, ...] = ()
    constraint: tuple[str, ...] = ()
    official: tuple[str, ...] = ()
    fresh: tuple[str, ...] = ()
    deictic: tuple[str, ...] = ()
    task: dict[str, tuple[str, ...]] = field(default_factory=dict)
    action: tuple[tuple[str, str], ...] = ()
    content: dict[str, tuple[str, ...]] = field(default_factory=dict)
    task_content: dict[str, tuple[str, ...]] = field(default_factory=dict)
    point: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @staticmethod
    def of(rows: list[tuple[str, str, str]]) -> Marks:
        """From rows (role, label, marker); the label of flat roles is not looked at."""
        flat: dict[str, list[str]] = {}
        labelled: dict[str, dict[str, list[str]]] = {}
        actions = []
        for role, label, marker in rows:
            if role == "action":
                actions.append((marker, label))
            elif role in _ORDER:
                labelled.setdefault(role, {}).setdefault(label, []).append(marker)
            else:
                flat.setdefault(role, []).append(marker)
        return Marks(**{k: tuple(dict.fromkeys(v)) for k, v in flat.items()}, **{k: {n: tuple(m) for n, m in v.items()} for k, v in labelled.items()}, action=tuple(actions))

    @staticmethod
    def read(table: DataFrame, most: int = 10_000) -> Marks:
        """From a table (place, role, label, marker), a rule table of so many rows at most."""
        rows = table.select("place", "role", "label", "marker").orderBy("place").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} marks")
        return Marks.of([(r["role"], r["label"], r["marker"]) for r in rows])


def rows() -> list[tuple[str, str, str]]:
    """The table that is used where a caller gives none."""
    flat = {"social": SOCIAL, "stopword": STOPWORDS, "generic": GENERIC, "environment": ENVIRONMENT, "constraint": CONSTRAINTS, "official": OFFICIAL, "fresh": FRESH, "deictic": DEICTIC}
    out = [(role, "", m) for role, markers in flat.items() for m in markers]
    out += [("action", label, m) for m, label in ACTIONS]
    labelled = {"task": {t: TASKS[t] for t in TASK_ORDER}, "content": CONTENT_TYPES, "task_content": TASK_CONTENT, "point": POINTS}
    return out + [(role, label, m) for role, table in labelled.items() for label, markers in table.items() for m in markers]


DEFAULT = Marks.of(rows())
