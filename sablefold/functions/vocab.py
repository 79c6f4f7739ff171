"""Own word lists for invented values; nothing here is anybody's data."""

FIRST = {
    "en_US": "Adra Belan Corin Davet Elsin Farrow Galen Hesper Ilvan Jorin Kestra Lorin Maven Nerys Orlan Perrin Quilla Rowan Selwyn Tarin Ulric Verin Wystan Xanthe Yorin Zelda Alby Brannic Celder Dorvan Emlyn Fenna Garrick Halden Isolde Jessamy Keld Lindon Merrin Nolan Osric Petra Quentin Rhosyn Stellan Tamsin Una Varric Wilder Yara".split(),
    "id_ID": "Adira Bagasra Candika Dewanti Elvira Faizan Gunadi Harsono Indira Jatmika Kirana Lestari Mahendra Nadira Okta Pramudya Qanita Rahayu Sekar Tirtana Ujang Vania Wicaksana Yudistira Zahwa Arka Binar Cahyani Damar Estu Fitria Gilang Hanum Intan Jaya Kemala Laras Mulia Nirmala Oksana Puspa Ratih Satria Tara Utari Wening".split(),
}
LAST = {
    "en_US": "Abernet Brackwell Cardowan Denhurst Ellingrove Farnley Gorsewood Hartwick Inglebrook Jessop Kilbrae Lanthorn Marchbank Northcott Oakhurst Penhallow Quarrington Redfern Silverlake Thornbury Underhill Vanterpool Westbrook Yarrow Zellweger Ashcombe Birchall Coldwater Dunmore Eastlake Foxley Glenister Holloway Ironside Kingsmere Langford Mossfield Netherby Orchardson Pemberly Ravenscroft Stonebridge Tidewell Valebrook Winterbourne".split(),
    "id_ID": "Adinegara Brataningrum Cakrawala Danurwenda Ekaputra Fadilah Gandasasmita Hadiningrat Irawanto Jayakusuma Kartanegara Lukitasari Mangkupraja Natadipura Ontowirjo Prawirayuda Rangkuti Sasmitaloka Tanuwijaya Umbaraji Wiradinata Yogaswara Zulkarnaen Atmadja Budiwarman Djojodipura Gunawijaya Kusumaputra Permadi Suryaningrat".split(),
}
STREET = "Alder Birch Cedar Dogwood Elm Fir Garland Hazel Ivy Juniper Kestrel Larch Maple Nettle Oak Poplar Quince Rowan Spruce Thistle Umber Violet Willow Yew".split()
KIND = "Street Avenue Lane Road Way Court".split()
CITY = "Ashport Brindle Calder Dunwich Easton Fairhaven Glenby Holtsville Inverley Jarrow Kelso Linden Marlow Newbridge Orford Pelham Quayside Redmoor Selby Tarrant Upwell Verwood Wexham Yarm".split()
DOMAIN = "example.com example.org example.net".split()
WORD = "amber basil copper delta ember fable grove harbor indigo jasper kelp lumen meadow nectar opal prairie quartz ridge saffron timber umbra velvet willow zephyr".split()


def of(table: dict[str, list[str]], locale: str | None) -> list[str]:
    return table.get(locale or "en_US", table["en_US"])
