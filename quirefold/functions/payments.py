"""Bills, proofs and messages of payments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

#: fixed values: the fields that are signed, in order
SIGNED = ("amount", "currency", "goods_name", "out_trade_no", "pay_before", "resource_id", "seller_id", "service_id")
# fixed values: goods by operation
GOODS = {
    "merge": "发票合并打印·1批（{n}张）",
    "extract": "发票台账提取·1批（{n}个）",
    "rename": "发票批量重命名·1批（{n}个）",
    "dedup": "发票批量查重·1批（{n}个）",
}
# fixed values: messages by error code
MESSAGES = {
    "PAYMENT_PROOF_NOT_FOUND": "支付凭证已过期或已使用，请重新支付",
    "PAYMENT_PROOF_STATUS_INVALID": "支付凭证已过期或已使用，请重新支付",
    "PAYMENT_PROOF_AGENT_MISMATCH": "支付凭证与商户/买家不匹配（安全拦截）",
    "PAYMENT_PROOF_ID_MISMATCH": "支付凭证与商户/买家不匹配（安全拦截）",
    "PAYMENT_PROOF_BUYER_MISMATCH": "支付凭证与商户/买家不匹配（安全拦截）",
    "PAYMENT_PROOF_TRADE_NO_MISMATCH": "支付凭证与交易号不匹配，请重新支付",
    "TRADE_STATUS_UNPAID": "支付尚未完成，请稍后重试",
    "TRADE_STATUS_CLOSED": "交易已关闭或不存在，请重新发起",
    "TRADE_NOT_FOUND": "交易已关闭或不存在，请重新发起",
    "CLIENT_SESSION_IS_EMPTY": "买家支付组件需升级到最新版后重试",
    "NETWORK_ERROR": "支付平台响应超时，请稍后重试（不会重复扣款）",
    "SYSTEM_ERROR": "支付宝服务繁忙，请重试（幂等安全）",
}
DEFAULT_MESSAGE = "支付验证失败，请重新支付"


def canonical_sign_string(fields: dict[str, Column]) -> Column:
    """k=v joined by & in the order of the names; null if one of them is missing."""
    return F.concat(*(x for i, k in enumerate(sorted(SIGNED)) for x in (F.lit(("&" if i else "") + k + "="), fields[k].cast("string"))))


# fixed values: what is said of a parameter that is not valid, by the kind of fault
FAULTS = {
    "missing": "缺少必填参数", "extra_forbidden": "包含不支持的参数", "string_type": "应为文本", "string_too_long": "内容过长",
    "string_too_short": "内容过短", "bool_type": "应为布尔值（true/false）", "int_type": "应为整数", "int_parsing": "应为整数",
    "float_type": "应为数字", "float_parsing": "应为数字", "number_type": "应为数字", "greater_than_equal": "数值低于下限",
    "less_than_equal": "数值超过上限", "greater_than": "数值低于下限", "less_than": "数值超过上限",
    "finite_number": "数值无效（不接受 NaN/Infinity）", "json_invalid": "请求体不是合法 JSON", "json_type": "请求体格式不正确",
    "list_type": "应为列表", "dict_type": "应为对象", "value_error": "参数不合法",
}


def fault_message(kind: Column, message: Column) -> Column:
    """What is said of a fault; its own message where the kind is not known."""
    return F.coalesce(_lookup(FAULTS, F.coalesce(kind, F.lit(""))), message)


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def goods_name(op: Column, n: Column) -> Column:
    return F.replace(_lookup(GOODS, op), F.lit("{n}"), n.cast("string"))


def error_message(code: Column) -> Column:
    return F.coalesce(_lookup(MESSAGES, F.coalesce(code, F.lit(""))), F.lit(DEFAULT_MESSAGE))


def base64url(s: Column) -> Column:
    """Base-64 with the alphabet for addresses, without padding."""
    return F.rtrim(F.translate(F.base64(F.encode(s, "utf-8")), "+/\r\n", "-_"), F.lit("="))


def from_base64url(s: Column) -> Column:
    """The text of base64url or base-64, padded or not; null if it is neither."""

    def text(t: Column) -> Column:
        padded = F.call_function("rpad", t, F.ceil(F.length(t) / 4).cast("int") * 4, F.lit("="))
        return F.call_function("try_validate_utf8", F.call_function("try_to_binary", F.when(t.rlike("^[A-Za-z0-9+/]*$"), padded), F.lit("base64")).cast("string"))

    return once(F.rtrim(F.translate(F.regexp_replace(s, "\\s", ""), "-_", "+/"), F.lit("=")), text)


_PROOF = "struct<protocol:struct<payment_proof:string,trade_no:string>,method:struct<client_session:string>>"


def decode_payment_proof(header: Column) -> Column:
    """(payment_proof, trade_no, client_session, reason): the reason is null for a good proof."""

    def fields(h: Column, text: Column, obj: Column) -> Column:
        proof, trade = obj["protocol"]["payment_proof"], obj["protocol"]["trade_no"]
        reason = (
            F.when(h == "", F.lit("empty"))
            .when(text.isNull(), F.lit("not_base64"))
            .when(~F.trim(text).rlike(r"(?s)^[\[{].*[\]}]$"), F.lit("not_json"))
            .when(F.startswith(F.trim(text), F.lit("[")), F.lit("not_an_object"))
            .when((F.coalesce(proof, F.lit("")) == "") | (F.coalesce(trade, F.lit("")) == ""), F.lit("incomplete"))
        )
        return once(reason, lambda r: F.struct(
            F.when(r.isNull(), proof).alias("payment_proof"),
            F.when(r.isNull(), trade).alias("trade_no"),
            F.when(r.isNull() & (obj["method"]["client_session"] != ""), obj["method"]["client_session"]).alias("client_session"),
            r.alias("reason"),
        ))

    parsed = lambda text: F.from_json(text, _PROOF, {"mode": "PERMISSIVE"})
    whole = lambda h: once(from_base64url(h), lambda text: once(parsed(text), lambda obj: fields(h, text, obj)))
    return once(F.trim(F.coalesce(header, F.lit(""))), whole)


def either_style(obj: Column, snake: str, default: str | None = None) -> Column:
    """A field of a JSON text by its snake_case name, else by its camelCase name."""
    head, *rest = snake.split("_")
    camel = head + "".join(w.capitalize() for w in rest)
    found = F.coalesce(F.get_json_object(obj, f"$.{snake}"), F.get_json_object(obj, f"$.{camel}"))
    return F.coalesce(found, F.lit(default)) if default is not None else found
