"""Fixed values of the text and scoring functions."""

# Separators that an alias is compared without.
ALIAS_DROPPED = "[\\s：:，,、;；/\\\\_\\-]+"
# Signs of units and their plain forms, one to one.
UNIT_FROM = "²³µμ／％（）°"
UNIT_TO = "23uu/%()℃"
# Full-width digits and signs and their plain forms, one to one.
WIDE_FROM = "０１２３４５６７８９．－～，"
WIDE_TO = "0123456789.-~,"
# The words that stand for yes and for no.
YES = ("true", "yes", "y", "1", "是", "有", "需要", "选中")
NO = ("false", "no", "n", "0", "否", "无", "不需要", "未选")
LIST_SEPARATORS = "[,;|，；、]+"
RATE = "^[0-9.]*\\s*[A-Za-z]+/[A-Za-z]+$"
QUALIFIERS = ("left", "right", "upper", "lower", "front", "rear", "first", "second", "main", "spare")
EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"
SECRET = "(?i)(password|token|secret|api[_-]?key)\\s*[:=]\\s*\\S+"
IDENTITY = "[0-9]{15,18}"
PHONE = "\\+?[0-9][0-9 -]{8,13}[0-9]"
# Words about how exact a number is, which are no part of its unit.
ABOUT = "以内|以下|左右|约|大约|可调"
# Digits and steps of Chinese numerals, with their formal forms.
CHINESE_DIGITS = {"零": 0, "〇": 0, "一": 1, "壹": 1, "二": 2, "贰": 2, "两": 2, "三": 3, "叁": 3, "四": 4, "肆": 4, "五": 5, "伍": 5, "六": 6, "陆": 6, "七": 7, "柒": 7, "八": 8, "捌": 8, "九": 9, "玖": 9}
CHINESE_STEPS = {"十": 10, "拾": 10, "百": 100, "佰": 100, "千": 1000, "仟": 1000}
COUNTERS = "套|件|台|个|pcs?|sets?"
# Field names that are about a document, and the field that each stands for.
DOCUMENT_FIELDS = {
    "合同号": "contract_number", "合同编号": "contract_number", "订单号": "order_number", "订单编号": "order_number", "产品编号": "product_number", "产品号": "product_number", "模头编号": "product_number",
    "客户": "customer_name", "客户名称": "customer_name", "客户id": "customer_id", "客户ID": "customer_id", "客户编号": "customer_id", "国家": "country", "下单日期": "order_date", "订单日期": "order_date", "交期": "delivery_date",
    "交货日期": "delivery_date", "日期": "order_date",
}
