"""Word lists, labels and constants the record formats prescribe."""

# --- sheet headers: canonical field -> accepted header texts, in declared order
FIELD_ALIASES: dict[str, list[str]] = {
    "template_name": ["template_name", "模板", "模板名称", "template"],
    "device_name": ["device_name", "气瓶名称", "设备名称", "仪器名称", "name"],
    "device_model": ["device_model", "型号规格", "规格型号", "型号", "规格", "model"],
    "device_code": ["device_code", "气瓶编号", "设备编号", "资产编号", "编号", "serial", "code"],
    "manufacturer": ["manufacturer", "生产厂商", "制造厂商", "制造厂/商", "厂家", "厂商"],
    "use_department": ["use_department", "使用部门", "部门", "使用科室", "科室"],
    "certificate_no": ["certificate_no", "证书编号", "证书号", "缆专检号", "certificate"],
    "client_name": ["client_name", "委托单位", "客户名称", "客户"],
    "receive_date": ["receive_date", "收样日期", "收样时间"],
    "calibration_date": ["calibration_date", "校准日期", "检定日期", "检测日期"],
    "location": ["location", "地点", "校准地点", "检定地点"],
    "temperature": ["temperature", "温度"],
    "humidity": ["humidity", "湿度"],
    "source_code": ["source_code", "模板代号", "来源代号", "模板编号"],
}
EXTRA_HEADER_LABELS = [
    "序号", "资产编号", "设备编号", "设备名称", "规格型号", "气瓶编号", "计量单位", "购置日期",
    "启用日期", "使用日期", "设备状态", "账面原值", "地点", "检验室", "原检验室",
]
HEADER_KEYWORDS = [
    "编号", "名称", "型号", "日期", "模板", "设备", "气瓶", "证书", "厂商", "厂家", "单位", "地址",
    "状态", "地点", "计量", "检验",
]
HEADER_SCAN_ROWS = 60

# --- aliases of already extracted fields (record context)
CONTEXT_ALIASES: dict[str, list[str]] = {
    "device_name": ["deviceName", "气瓶名称", "设备名称", "仪器名称", "name"],
    "device_model": ["deviceModel", "型号", "型号规格", "型号/规格", "规格型号", "model"],
    "device_code": ["deviceCode", "气瓶编号", "设备编号", "仪器编号", "资产编号", "编号", "serial", "code"],
    "manufacturer": ["manufacturerName", "生产厂商", "制造厂商", "制造厂/商", "制造商", "厂家", "厂商"],
    "basis_standard": ["calibration_basis", "basis", "检测依据", "校准依据", "检测/校准依据", "技术规范代号"],
    "location": ["校准地点", "检测地点", "地点"],
    "temperature": ["温度"],
    "humidity": ["湿度"],
    "certificate_no": ["证书编号", "证书号", "缆专检号"],
    "client_name": ["委托单位", "客户名称", "客户"],
    "receive_date": ["收样日期", "收样时间"],
    "calibration_date": ["校准日期", "检定日期", "检测日期"],
}

# --- placeholders
BLANK_TOKEN = "__BLANK__"
PLACEHOLDER_CELLS = ["", "-", "--", "—", "/", "／"]
DATE_WORDS = ["receiveddate", "dateforcalibration", "year", "month", "day"]
PLACEHOLDER_NAMES = ["instrumentname", "devicename", "equipmentname", "气瓶名称", "设备名称", "仪器名称"]
PLACEHOLDER_MODEL_MARKS = ["modelspecification", "instrumentserialnumber", "型号编号", "型号规格"]
PLACEHOLDER_CODES = ["instrumentserialnumber", "serialnumber"]
HEADER_ROW_MODEL_MARKS = [
    "modelspecification", "model/specification", "规格model/specification", "instrumentserialnumber",
    "serialnumber", "型号规格", "型号/编号",
]
MEANINGLESS_TOKENS = [
    "instrumentname", "devicename", "equipmentname", "modelspecification", "instrumentserialnumber",
    "serialnumber", "manufacturer", "client", "气瓶名称", "设备名称", "仪器名称", "型号规格", "型号",
    "编号", "气瓶编号", "设备编号", "生产厂商", "制造厂商", "厂家", "厂商",
]

# --- labels of free-text records: field -> labels, in declared order
TEXT_LABELS: dict[str, list[str]] = {
    "device_name": ["气瓶名称", "设备名称", "仪器名称", "instrument name"],
    "device_model": ["型号/规格", "型号规格", "型号", "model/specification", "model"],
    "device_code": ["气瓶编号", "设备编号", "编号", "instrument serial number", "serial number"],
    "manufacturer": ["制造厂/商", "生产厂商", "制造厂商", "manufacturer"],
    "unit_name": ["委托单位", "单位名称", "client"],
    "address": ["地址", "地 址", "address"],
    "contact_info": ["联系方式", "电话", "tel", "contact"],
    "certificate_no": ["缆专检号", "certificate series number", "certificate no"],
    "receive_date": ["收样日期", "received date"],
    "calibration_date": ["校准日期"],
    "release_date": ["发布日期", "issue date", "date of issue", "date of publication"],
    "location": ["地点", "校准地点"],
    "basis_standard": [
        "本次校准所依据的技术规范", "技术规范代号", "检测依据", "校准依据", "检测/校准依据",
        "reference documents for the calibration",
    ],
}
LABEL_LINE_TOKENS = [
    "气瓶名称", "设备名称", "仪器名称", "instrumentname", "型号规格", "型号", "规格", "modelspecification",
    "model", "气瓶编号", "设备编号", "编号", "instrumentserialnumber", "serialnumber", "制造厂商", "生产厂商",
    "manufacturer", "委托单位", "单位名称", "client", "地址", "address", "联系方式", "电话", "contact", "tel",
    "缆专检号", "certificateseriesnumber", "certificateno", "收样日期", "receiveddate", "校准日期",
    "dateforcalibration", "发布日期", "issuedate", "dateofissue", "dateofpublication", "地点", "校准地点",
]
LABEL_LINE_MARKS = [
    "instrumentname", "modelspecification", "model", "instrumentserialnumber", "serialnumber", "manufacturer",
    "certificateseriesnumber", "气瓶名称", "型号规格", "气瓶编号", "制造厂商", "生产厂商",
]
FIELD_LABEL_TOKENS = {
    "device_model": ["型号", "规格", "型号规格", "modelspecification"],
    "device_code": ["编号", "气瓶编号", "设备编号", "serialnumber"],
    "manufacturer": ["manufacturer", "制造厂商", "生产厂商", "厂家", "厂商"],
    "receive_date": ["收样日期", "receiveddate"],
    "calibration_date": ["校准日期", "dateforcalibration"],
    "release_date": ["发布日期", "issuedate", "dateofissue", "dateofpublication"],
}
# field -> patterns tried in order; the last group is the value
FIELD_PATTERNS: dict[str, list[str]] = {
    "device_name": [r"(设备名称|气瓶名称|仪器名称|品名)[:：]?\s*(.+)"],
    "device_model": [r"(设备型号|型号|规格型号|Model|TYPE)[:：]?\s*(.+)"],
    "device_code": [r"(设备编号|编号|出厂编号|No\.?|Serial No)[:：]?\s*(.+)"],
    "manufacturer": [r"(生产厂家|制造厂家|厂家|制造单位|Manufacturer)[:：]?\s*(.+)"],
    "certificate_no": [r"(缆专检号|Certificate\s*series\s*number)[:：]?\s*([A-Za-z0-9\-]+)"],
    "client_name": [r"(委托单位|Client)[:：]?\s*(.+)"],
    "receive_date": [r"(收样日期|Received date)[:：]?\s*(\d{4}[^\n]{0,12})"],
    "calibration_date": [r"(校准日期|Date for calibration)[:：]?\s*(\d{4}[^\n]{0,12})"],
}

# Where a field is looked for once labels and FIELD_PATTERNS gave nothing, in this order.
# kind, then its arguments: 'kept' (what is there already), 'good' (the same unless of low quality), 'text' (pattern over
# the text, first group), 'near' (labels, then a pattern on that line or the two below), 'date' (label),
# 'environment' (value), 'line' (pattern that a whole line holds), 'model line', 'model token', 'maker line', 'code line',
# 'first line', 'joined' (an array field), 'model'.
FIELD_RULES: list[tuple[str, int, str, tuple[str, ...]]] = [
    ("device_name", 1, "kept", ()),
    ("device_name", 1, "text", (r"(?:设备名称|气瓶名称|仪器名称)[:：]?\s*([^\n]+)",)),
    ("device_name", 1, "text", (r"(局放仪|局部放电[^\n]{0,20}(?:系统|仪|装置))",)),
    ("device_name", 2, "kept", ()),
    ("device_name", 2, "line", ("系统|设备|试验|检测|装置|平台|仪器|System|Equipment",)),
    ("device_name", 2, "first line", ()),
    ("device_model", 1, "kept", ()),
    ("device_model", 1, "model line", (r"型号\s*/\s*编号|型号规格|型号", r"([A-Za-z][A-Za-z0-9\- ℃]{1,30}:[A-Za-z0-9\-]{4,})")),
    ("device_model", 1, "text", (r"(?:型号/编号|型号规格|型号)[:：]?\s*([A-Za-z0-9\-_./ ]+)",)),
    ("device_model", 1, "text", (r"(?:Type\s*model|Type)[:：]?\s*([A-Za-z0-9\-_./ ]{3,50})",)),
    ("device_model", 1, "near", ("型号", "Type", r"([A-Za-z][A-Za-z0-9\-_/\. ]{2,40})")),
    ("device_model", 2, "kept", ()),
    ("device_model", 2, "model token", (r"([A-Za-z0-9][A-Za-z0-9\-_/]{3,})",)),
    ("device_code", 1, "kept", ()),
    ("device_code", 1, "text", (r"(?:型号/编号)[:：]?\s*[A-Za-z0-9\-_./ ]*[:：]?\s*([A-Za-z0-9\-_./]+)",)),
    ("device_code", 1, "text", (r"(?:设备编号|气瓶编号|编号)[:：]?\s*([A-Za-z0-9\-_./]+)",)),
    ("device_code", 1, "text", (r"(?:Number|Serial No\.?)[:：]?\s*([A-Za-z0-9\-_./]+)",)),
    ("device_code", 1, "near", ("编号", "Number", "Serial", r"([A-Za-z0-9\-_./]{4,})")),
    ("device_code", 3, "kept", ()),
    ("device_code", 3, "code line", (r"设备编号|编号|出厂编号|Serial|No\.?",)),
    ("unit_name", 1, "kept", ()),
    ("unit_name", 1, "text", (r"单位名称[:：]?\s*([^\n]+)",)),
    ("unit_name", 1, "text", (r"委托单位[:：]?\s*([^\n]+)",)),
    ("address", 1, "kept", ()),
    ("address", 1, "text", (r"地址[:：]?\s*([^\n]+)",)),
    ("address", 1, "text", (r"地点[:：]?\s*([^\n]+)",)),
    ("location", 1, "kept", ()),
    ("location", 1, "environment", ("location",)),
    ("temperature", 1, "environment", ("temperature",)),
    ("humidity", 1, "environment", ("humidity",)),
    ("power_rating", 1, "text", (r"电源/功率[:：]?\s*([^\n]+)",)),
    ("power_rating", 1, "text", (r"电源功率[:：]?\s*([^\n]+)",)),
    ("power_rating", 1, "text", (r"(?:输出容量|额定功率|Rated power)\s*[:：]?\s*([0-9]+(?:\.[0-9]+)?\s*(?:kVA|KVA|kW|KW|W)?)",)),
    ("power_rating", 1, "near", ("输出容量", "额定功率", "Rated power", r"([0-9]+(?:\.[0-9]+)?\s*(?:kVA|KVA|kW|KW|W))")),
    ("manufacture_date", 1, "date", ("制造日期",)),
    ("manufacture_date", 1, "date", ("生产日期",)),
    ("manufacture_date", 1, "date", ("制造年月",)),
    ("manufacture_date", 1, "date", ("Date of manufacture",)),
    ("contact_info", 1, "kept", ()),
    ("contact_info", 1, "text", (r"联系方式[:：]?\s*([^\n]+)",)),
    ("contact_info", 1, "text", (r"(电话[:：]?\s*[0-9\- ]{7,})",)),
    ("manufacturer", 1, "kept", ()),
    ("manufacturer", 1, "text", (r"(?:生产厂商|制造厂商|厂家|厂商)[:：]?\s*([^\n]+)",)),
    ("manufacturer", 2, "kept", ()),
    ("manufacturer", 2, "maker line", (r"公司|有限|厂商|厂家|Manufacturer", r"有限公司|有限责任公司|ELECTRIX|TECHNOLOGY\s*CO\.?\.?\s*LTD")),
    ("certificate_no", 1, "kept", ()),
    ("certificate_no", 1, "text", (r"缆专检号[:：]?\s*([A-Za-z0-9\-]+)",)),
    ("certificate_no", 1, "text", (r"Certificate\s*series\s*number[:：]?\s*([A-Za-z0-9\-]+)",)),
    ("client_name", 1, "kept", ()),
    ("client_name", 1, "text", (r"委托单位[:：]?\s*([^\n]+)",)),
    ("client_name", 1, "text", (r"Client[:：]?\s*([^\n]+)",)),
    ("receive_date", 1, "good", ()),
    ("receive_date", 1, "date", ("收样日期",)),
    ("calibration_date", 1, "good", ()),
    ("calibration_date", 1, "date", ("校准日期",)),
    ("release_date", 1, "good", ()),
    ("release_date", 1, "date", ("发布日期",)),
    ("release_date", 1, "date", ("Issue date",)),
    ("basis_standard", 2, "kept", ()),
    ("basis_standard", 2, "joined", ("basis_standard_items",)),
    ("measurement_items", 2, "joined", ("items",)),
]
# Parts of lines that are no value, and lines that name the owner.
OWNER_LINE = "^(?:单位名称|委托单位|client)"
MAKER_NOISE = [
    r"(?i)^(?:生产厂商|制造厂/商|制造厂商|厂家|厂商|Manufacturer)\s*[:：]?\s*", r"https?://\S+", r"(?i)(电话|Tel)[:：]?\s*[0-9\- ]{6,}$",
]
COMBINED_LABEL = r"型号\s*/\s*编号"
# Words of the lines of number series, and of relative uncertainties.
SERIES_WORDS: dict[str, list[str]] = {
    "pd_charge_values_pc": ["电荷量", "放电量"],
    "pd_rise_time_values_ns": ["上升沿"],
    "pd_pulse_amplitude_values_v": ["脉冲幅值", "波形峰值"],
}
UREL_WORDS: dict[str, list[str]] = {
    "pd_voltage_urel_percent": ["试验电压", "电压"],
    "pd_scan_time_urel_percent": ["扫描时间", "扫描"],
    "pd_capacitance_urel_percent": ["电容"],
    "pd_power_tolerance_urel_percent": ["电流容差", "电源容差", "容差"],
    "pd_voltage_calibration_urel_percent": ["电压校准", "校准脉冲", "校准"],
}
LABEL_VALUE_WORDS = [
    "client", "manufacturer", "instrumentname", "devicename", "equipmentname", "instrumentserialnumber",
    "modelspecification", "modelnumber", "measurementrange", "certificateseriesnumber", "certificate",
    "number", "serialnumber", "code", "receiveddate", "dateforcalibration", "year", "month", "day",
]

# --- instrument catalogue
CATALOG_KEYS = [
    "name", "model", "code", "measurement_range", "uncertainty", "certificate_no", "valid_date",
    "traceability_institution",
]
CATALOG_NAME_TOKENS = ["气瓶名称", "设备名称", "仪器名称", "instrumentname", "devicename"]
CATALOG_HEADERS: dict[str, list[str]] = {
    "name": ["气瓶名称", "设备名称", "仪器名称", "instrumentname", "devicename"],
    "model": ["型号规格", "型号", "规格型号", "modelspecification"],
    "code": ["编号", "气瓶编号", "设备编号", "仪器编号", "出厂编号", "number", "serialnumber", "instrumentserialnumber"],
    "measurement_range": ["测量范围", "量程", "measurementrange", "range"],
    "uncertainty": [
        "准确度等级或最大允许误差或不确定度", "最大允许误差", "不确定度", "uncertainty", "maximumpermissibleerrors",
    ],
    "certificate_no": ["证书编号", "证书号", "certificatenumber", "certificateid"],
    "valid_date": ["有效期限", "有效期", "validdate", "validuntil", "validity"],
    "traceability_institution": [
        "溯源机构名称", "溯源机构", "traceabilityinstitution", "nameoftraceabilityinstitution",
    ],
}
CATALOG_HEADER_TOKENS = [
    "气瓶总目录", "气瓶名称", "型号规格", "编号", "测量范围", "准确度等级或最大允差或不确定度", "证书编号有效期限",
    "溯源机构名称", "instrumentname", "modelspecification", "number", "measurementrange",
    "certificatenumbervaliddate", "nameoftraceabilityinstitution",
]
CATALOG_STOP_NAMES = ["以上计量标准气瓶", "其它校准信息"]
STACK_ANCHORS = ["name", "model", "code", "measurement_range", "certificate_no", "traceability_institution"]
INSTRUMENT_TABLE_HEADER = [
    "计量标准气瓶名称", "型号/规格", "编号", "测量范围", "准确度/不确定度", "证书编号/有效期", "溯源机构",
]

# --- recognised cylinder table
TABLE_COLUMNS = 37
CRITICAL_COLUMNS = [0, 2, 3, 4, 5, 6, 8, 17, 19, 25, 27, 32, 33]
MEDIUM_NAMES = ["Ar", "O2", "N2", "CO2"]
MEDIUM_MISREADS = {"CO2": "CO2", "COZ": "CO2", "C02": "CO2", "02": "O2", "AR": "Ar", "N2": "N2", "O2": "O2"}
MEDIUM_LINE_MISREADS = {
    "A": "Ar", "HR": "Ar", "AR": "Ar", "AIR": "Ar", "A1": "Ar", "AI": "Ar", "02": "O2", "OZ": "O2",
    "N2": "N2", "C02": "CO2", "CO2": "CO2",
}
UNIT_CODES = ["GZ", "YM", "FC", "JP"]
REVIEW_THRESHOLD = 0.85
REVIEW_THRESHOLD_CRITICAL = 0.92
SECOND_PASS_TRIGGER = 0.60
NOISE_CONFIDENCE = 0.45
MIN_NON_EMPTY_RATIO = 0.24
MIN_CRITICAL_RATIO = 0.18
MAX_REVIEW_RATIO = 0.72
ROTATION_HINTS = [
    "型号", "编号", "输入电压", "输出电压", "输入电流", "输出电流", "频率", "生产日期", "使用条件", "局部放电",
    "局放仪", "有限公司", "Type", "model",
]
VALVE_CHECK_WORDS = "校阀|校调|校調|收阀|收调|政调|农调|回校"
VALVE_SWAP_WORDS = "换阀|換阀|换间|换询|换具|换惘|換間|换网"
VALVE_CONFLICT = "瓶阀检验冲突：同一行同时命中“校阀”和“换阀”，已置空"
CHECKMARK_LABELS = [
    "余气处理", "外观清理检查", "音响检查", "内表面检查", "瓶口螺纹检查", "内部干燥", "试验结论", "评定结论",
]
CHUNK_GROUPS = [
    "钢印标记检查及余气处理", "外观及螺纹检查", "重量与容积测定", "水压试验", "气密性试验", "结果评定",
]
DEFAULT_GROUP = "基础信息"

# --- matching
NAME_SYNONYMS = [
    ("软击穿", "软化击穿"), ("伸长率试验仪", "伸长试验仪"), ("伸长率", "伸长"), ("高温试验箱", "高温箱"),
    ("金属扭转", "线材扭转"), ("扁线弯曲", "扁线回弹"), ("扁线回弹角", "扁线回弹"),
    ("缠绕能力试验仪", "线材卷绕试验机"), ("低温箱", "低温试验箱"), ("干燥箱", "试验箱"),
    ("希波火花机", "火花机人工击穿装置"), ("介损", "局部放电"), ("5kv高压台", "电线电缆电压试验装置"),
    ("热态电压试验箱", "电热强制通风试验箱热态电压试验仪"), ("低应力拉伸仪", "低温拉伸试验机"),
    ("摩擦系数仪", "静摩擦系数试验仪"), ("往复弯折试验仪", "曲挠试验装置"), ("耐氟试验仪", "耐溶剂试验仪"),
    ("自动回弹角试验仪（1.60以上）", "扁线回弹试验仪"), ("自动回弹角试验仪(1.60以上)", "扁线回弹试验仪"),
    ("自动回弹角试验仪（160以上）", "扁线回弹试验仪"), ("自动回弹角试验仪(160以上)", "扁线回弹试验仪"),
    ("自动回弹角试验仪160以上", "扁线回弹试验仪"), ("耐溶剂试验仪（温场）", "耐溶剂试验仪"),
    ("耐溶剂试验仪(温场)", "耐溶剂试验仪"), ("耐溶剂试验仪（力值）", "耐溶剂试验仪"),
    ("耐溶剂试验仪(力值)", "耐溶剂试验仪"), ("耐溶剂试验仪温场", "耐溶剂试验仪"),
    ("耐溶剂试验仪力值", "耐溶剂试验仪"),
]
NAME_WHOLE_SYNONYMS = {
    "卷绕": "线材卷绕试验机", "卷绕试验仪": "线材卷绕试验机", "立绕试验仪": "绕组线卷绕试验仪",
    "立绕": "绕组线卷绕试验仪",
}
NAME_SUFFIXES = [
    "原始记录", "核查记录", "记录", "模板", "试验仪", "试验机", "试验装置", "试验系统", "试验箱", "系统", "设备",
    "仪器", "装置", "测试",
]
BLANK_TEMPLATE = "R-802B 空白.docx"
TEMPLATE_PROFILES = [
    {"code": "r-801b", "aliases": ["R-801B", "R_801B"], "all": ["本次任务信息和计量标准气瓶清单"], "any": []},
    {"code": "r-803b", "aliases": ["R-803B", "R_803B"], "all": ["低温冲击", "缆专检号", "气瓶名称", "型号/规格"], "any": []},
    {"code": "r-825b", "aliases": ["R-825B", "R_825B", "软化击穿试验仪", "软击穿试验仪"], "all": ["软化击穿"], "any": []},
    {"code": "r-819b",
     "aliases": ["R-819B", "R_819B", "局部放电测试系统", "局部放电检测系统", "局放检测系统", "局放测试系统"],
     "all": ["局部放电", "系统"], "any": []},
    {"code": "r-859b", "aliases": ["R-859B", "R_859B", "工频高电压测量系统"], "all": ["工频高电压测量系统"], "any": []},
]
GENERIC_KEYWORDS = [
    "校准", "校准结果", "说明", "续页", "结果", "证书", "原始记录", "检测", "试验", "系统", "设备", "仪器", "有限公司", "第页", "共页",
]
KEYWORD_NOISE_LINES = [
    r"^第\s*\d+\s*页\s*[\/／]\s*共\s*\d+\s*页$", r"^page\s+\d+\s+of\s+\d+$", r"^page\s+of\s+total\s+pages$",
    r"^校准证书续页专用$", r"^continued\s+page\s+of\s+calibration\s+certificate$",
]
KEYWORD_BOOSTS = [r"局放|局部放电", r"(?i)\d{2,4}k?v|kV", r"电缆|附件|耐压|脉冲|灵敏度|衰减"]
#: A boosted token holds one of these or a character beyond ASCII.
KEYWORD_BOOST_SIGNS = ["v", "V"]
ANCHOR_GROUPS = [
    ["温度", "℃", "°c", "c"], ["夹角", "角度", "°"], ["力值", "牛", "n"], ["电阻", "ω", "Ω", "欧姆"],
    ["距离", "间距"], ["宽度", "刀口"], ["夹具", "夹头"], ["平行", "互相平行"],
]
SIMILARITY_SYNONYMS = [
    ("旋转夹头", "夹头"), ("定位夹头", "夹头"), ("两夹头", "两夹具"), ("夹头间", "夹具间"),
    ("最大起始距离", "最大距离"),
]
# requirement keywords -> evidence keywords (any of each)
REQUIREMENT_RULES = [
    (["双向旋转", "旋转夹头", "转速均匀", "转速稳定"], ["双向旋转", "旋转夹头", "转速均匀", "转速稳定"]),
    (["最大距离", "两夹具间距离", "标度尺"], ["两夹头间", "两夹具间", "距离"]),
    (["施加负荷", "平直状态", "试样始终处于平直"], ["施加负荷", "平直状态", "试件处于平直", "试件始终处于平直"]),
    (["扭转次数", "计数器"], ["扭转次数", "计数器", "次数记录装置"]),
    (["负荷齐全", "满足试验要求"], ["负荷齐全", "满足试验要求"]),
]
RECORD_TABLE_THRESHOLD = 4
RECORD_TABLE_MARKS = [
    (2, ["气瓶名称", "设备名称", "仪器名称"]), (2, ["型号/规格", "型号规格", "规格型号"]),
    (2, ["气瓶编号", "设备编号", "仪器编号"]),
    (1, ["制造厂/商", "制造厂", "制造商", "生产厂商", "厂商", "厂家"]), (1, ["校准依据", "检测依据", "依据"]),
    (1, ["校准地点", "检测地点", "地点"]), (1, ["原始记录"]),
]

# --- formulas
BASE_FORMULAS = [
    {"type": "unify_dates", "receive_key": "receive_date", "calibration_key": "calibration_date"},
    {"type": "date_offset", "source_key": "calibration_date", "fallback_key": "receive_date",
     "target_key": "publish_date", "days": 1},
    {"type": "linearity_metrics", "ux_key": "linearity_ux_values", "u2_key": "linearity_u2_values",
     "fi_key": "linearity_fi_values", "f_avg_key": "linearity_f_avg",
     "delta_key": "linearity_fi_delta_percent", "precision": 6, "delta_precision": 4},
]
_LINEARITY = [BASE_FORMULAS[2]]
FORMULA_PROFILES = [
    (r"r[-_ ]?859b|工频高电压测量系统|040\s*工频高电压测量系统", _LINEARITY),
    (r"r[-_ ]?860b|直流高电压测量系统", _LINEARITY),
    (r"r[-_ ]?875b|交流通用分压器测量系统", _LINEARITY),
    (r"r[-_ ]?876b|直流通用分压器测量系统", _LINEARITY),
    (r"r[-_ ]?877b|冲击电压通用分压器测量系统", _LINEARITY),
    (r"036\s*局放|037\s*局放|局部放电|PDIV|PDEV", [
        {"type": "list_mean", "source_key": "pd_charge_values_pc", "target_key": "pd_charge_avg_pc", "precision": 4},
        {"type": "list_mean", "source_key": "pd_rise_time_values_ns", "target_key": "pd_rise_time_avg_ns",
         "precision": 4},
        {"type": "list_mean", "source_key": "pd_pulse_amplitude_values_v", "target_key": "pd_pulse_amplitude_avg_v",
         "precision": 4}]),
    (r"882b|屏蔽室", [
        {"type": "list_subtract", "left_key": "shield_p1_dbm_values", "right_key": "shield_p2_dbm_values",
         "target_key": "shield_se_db_values", "precision": 3},
        {"type": "list_mean", "source_key": "shield_se_db_values", "target_key": "shield_se_avg_db",
         "precision": 3}]),
    (r"56\s*20kv击穿电压试验仪|58\s*15kv击穿电压试验仪|击穿电压试验仪", [
        {"type": "list_mean", "source_key": "breakdown_voltage_values_kv",
         "target_key": "breakdown_voltage_avg_kv", "precision": 4},
        {"type": "list_stddev", "source_key": "breakdown_voltage_values_kv",
         "target_key": "breakdown_voltage_stddev_kv", "precision": 4}]),
]
TEMPLATE_RULES = [("r825b", r"r[-_ ]?825b", 6), ("r803b", r"r[-_ ]?803b", 5), ("default", r".*", 0)]
TEMPLATE_REQUIRED_FIELDS = {"r808b": ["temperature", "humidity"]}

# --- records and reports
SOURCE_PROFILE_LABELS = {
    "excel_row": "Excel行", "multi_device_baseinfo_word": "多基础信息Word", "template_form_word": "模板单记录Word",
    "single_device_with_scope": "单设备含范围", "single_device_general": "单设备通用",
    "multi_device_baseinfo_word_split": "多基础信息Word-拆分",
}
SUPPLEMENT_HIDDEN_KEYS = [
    "devicename", "device_model", "devicemodel", "devicecode", "manufacturer", "unitname", "address",
    "powerrating", "manufacturedate", "contactinfo", "measurementitems", "measurementitemcount", "rawrecord",
    "气瓶名称", "设备名称", "仪器名称", "型号规格", "型号", "编号", "气瓶编号", "设备编号", "生产厂商", "制造厂商",
    "厂家", "厂商", "使用部门", "单位名称", "地址", "电源功率", "制造日期", "生产日期", "联系方式", "检测项数",
]
SHARED_DEVICE_FIELDS = [
    "manufacturer", "unit_name", "address", "client_name", "certificate_no", "receive_date", "calibration_date",
    "release_date",
]
TASK_STATUSES = ["待处理", "草稿", "已生成"]
BASIC_FIELDS = [
    "device_name", "manufacturer", "device_model", "device_code", "certificate_no", "basis_standard", "location",
    "temperature", "humidity",
]
BASIC_FIELD_MARKS = {
    "device_name": ["气瓶名称", "设备名称", "仪器名称"],
    "manufacturer": ["制造厂/商", "制造商", "生产厂商", "厂商", "厂家"],
    "device_model": ["型号/规格", "型号", "规格型号", "型号/编号"],
    "device_code": ["气瓶编号", "设备编号", "仪器编号", "编号"],
    "certificate_no": ["缆专检号", "证书编号", "证书号", "序号"],
    "basis_standard": ["依据", "检测依据", "校准依据"],
    "location": ["地点", "检测地点", "校准地点"],
    "temperature": ["温度"],
    "humidity": ["湿度", "RH"],
}
# markers -> keys a document needs
FIELD_KEY_GROUPS = [
    (["检测/校准依据", "检测依据", "校准依据", "依据"], ["basis_mode", "basis_standard"]),
    (["检测/校准地点", "检测地点", "校准地点", "地点"], ["location"]),
    (["温度"], ["temperature"]),
    (["湿度", "%RH", "RH"], ["humidity"]),
    (["一般检查", "校准结果", "结果："], ["general_check_full"]),
    (["检测项目", "测量项目", "主要计量标准气瓶"], ["measurement_items"]),
    (["高电压测量系统", "分压器测量系统", "Urel", "线性度", "Ux", "U2", "Fi"], [
        "urel_percent", "voltage_range_1", "voltage_indicated_values_1", "voltage_actual_values_1",
        "voltage_range_2", "voltage_indicated_values_2", "voltage_actual_values_2", "voltage_range_3",
        "voltage_indicated_values_3", "voltage_actual_values_3", "linearity_ux_values", "linearity_u2_values",
        "linearity_fi_values", "linearity_f_avg", "linearity_fi_delta_percent"]),
    (["局放", "部分放电", "PDIV", "PDEV", "放电量", "脉冲幅值", "上升沿"], [
        "pd_charge_values_pc", "pd_charge_avg_pc", "pd_rise_time_values_ns", "pd_rise_time_avg_ns",
        "pd_pulse_amplitude_values_v", "pd_pulse_amplitude_avg_v", "pd_voltage_urel_percent",
        "pd_scan_time_urel_percent", "pd_capacitance_urel_percent", "pd_power_tolerance_urel_percent",
        "pd_voltage_calibration_urel_percent"]),
    (["屏蔽室", "屏蔽效能", "背景噪声", "P1(dBm)", "P2(dBm)"], [
        "shield_background_noise_0kv_pc", "shield_background_noise_working_kv_pc", "shield_p1_dbm_values",
        "shield_p2_dbm_values", "shield_se_db_values", "shield_se_avg_db"]),
    (["击穿电压", "耐压", "标准偏差"], [
        "breakdown_voltage_values_kv", "breakdown_voltage_avg_kv", "breakdown_voltage_stddev_kv"]),
]
CORE_FIELD_KEYS = ["certificate_no", "device_name", "manufacturer", "device_model", "device_code"]
FIELD_LABELS = {
    "certificate_no": "序号", "device_name": "气瓶名称", "manufacturer": "制造厂/商", "device_model": "型号/规格",
    "device_code": "气瓶编号", "basis_mode": "依据类型（检测/校准）", "basis_standard": "检测/校准依据",
    "temperature": "温度 (℃)", "humidity": "湿度 (%RH)", "location": "检测/校准地点",
    "measurement_items": "检测项目", "general_check_full": "校准结果/说明（续页）",
    "urel_percent": "扩展不确定度 Urel (%)", "voltage_range_1": "量程1 (kV)",
    "voltage_indicated_values_1": "量程1 指示值(kV)", "voltage_actual_values_1": "量程1 实际值(kV)",
    "voltage_range_2": "量程2 (kV)", "voltage_indicated_values_2": "量程2 指示值(kV)",
    "voltage_actual_values_2": "量程2 实际值(kV)", "voltage_range_3": "量程3 (kV)",
    "voltage_indicated_values_3": "量程3 指示值(kV)", "voltage_actual_values_3": "量程3 实际值(kV)",
    "linearity_ux_values": "被校系统工频高压示值 Ux(kV)", "linearity_u2_values": "变压器空载输出电压示值 U2(V)",
    "linearity_fi_values": "Ux 和 U2 比值 Fi", "linearity_f_avg": "Fi 平均值 F",
    "linearity_fi_delta_percent": "Fi 与 F 的相对变化量(%)", "pd_charge_values_pc": "局放电荷量序列 (pC)",
    "pd_charge_avg_pc": "局放电荷量平均值 (pC)", "pd_rise_time_values_ns": "局放上升沿时间序列 (ns)",
    "pd_rise_time_avg_ns": "局放上升沿时间平均值 (ns)", "pd_pulse_amplitude_values_v": "局放脉冲幅值序列 (V)",
    "pd_pulse_amplitude_avg_v": "局放脉冲幅值平均值 (V)", "pd_voltage_urel_percent": "局放电压 Urel (%)",
    "pd_scan_time_urel_percent": "局放扫描时间 Urel (%)", "pd_capacitance_urel_percent": "局放电容 Urel (%)",
    "pd_power_tolerance_urel_percent": "局放试验电源容差 Urel (%)",
    "pd_voltage_calibration_urel_percent": "局放试验电压校准 Urel (%)",
    "shield_background_noise_0kv_pc": "屏蔽室0kV背景噪声 (pC)",
    "shield_background_noise_working_kv_pc": "屏蔽室工作电压背景噪声 (pC)",
    "shield_p1_dbm_values": "无屏蔽室功率 P1(dBm)", "shield_p2_dbm_values": "屏蔽室内功率 P2(dBm)",
    "shield_se_db_values": "屏蔽效能序列 SE(dB)", "shield_se_avg_db": "屏蔽效能平均值 SE(dB)",
    "breakdown_voltage_values_kv": "击穿电压序列 (kV)", "breakdown_voltage_avg_kv": "击穿电压平均值 (kV)",
    "breakdown_voltage_stddev_kv": "击穿电压标准偏差 (kV)",
}
