"""Word_Break classes of Unicode as ranges of code points, as far as words depend on them.

ALONE are letters and digits without a class, of which each is a word: ideographs,
hiragana, Thai and the like.  EXTEND has Format and ZWJ too.
LETTER_ALNUM are letters in a class that str.isalnum doesn't know.
"""

LETTER = """
41-5A 61-7A AA B5 B8 BA C0-D6 D8-F6 F8-2D7 2DE-2FF 370-374 376-377 37A-37D 37F 386 388-38A 38C 38E-3A1 3A3-3F5 3F7-481 48A-52F 531-556 558-55C 55E
560-588 58A-58C 5F3 620-64A 66E-66F 671-6D3 6D5 6E5-6E6 6EE-6EF 6FA-6FC 6FF 70F-710 712-72F 74D-7A5 7B1 7CA-7EA 7F4-7F5 7FA 800-815 81A 824 828
840-858 860-86A 870-887 889-88F 8A0-8C9 904-939 93D 950 958-961 971-980 985-98C 98F-990 993-9A8 9AA-9B0 9B2 9B6-9B9 9BD 9CE 9DC-9DD 9DF-9E1 9F0-9F1
9FC A05-A0A A0F-A10 A13-A28 A2A-A30 A32-A33 A35-A36 A38-A39 A59-A5C A5E A72-A74 A85-A8D A8F-A91 A93-AA8 AAA-AB0 AB2-AB3 AB5-AB9 ABD AD0 AE0-AE1 AF9
B05-B0C B0F-B10 B13-B28 B2A-B30 B32-B33 B35-B39 B3D B5C-B5D B5F-B61 B71 B83 B85-B8A B8E-B90 B92-B95 B99-B9A B9C B9E-B9F BA3-BA4 BA8-BAA BAE-BB9 BD0
C05-C0C C0E-C10 C12-C28 C2A-C39 C3D C58-C5A C5C-C5D C60-C61 C80 C85-C8C C8E-C90 C92-CA8 CAA-CB3 CB5-CB9 CBD CDC-CDE CE0-CE1 CF1-CF2 D04-D0C D0E-D10
D12-D3A D3D D4E D54-D56 D5F-D61 D7A-D7F D85-D96 D9A-DB1 DB3-DBB DBD DC0-DC6 F00 F40-F47 F49-F6C F88-F8C 10A0-10C5 10C7 10CD 10D0-10FA 10FC-1248
124A-124D 1250-1256 1258 125A-125D 1260-1288 128A-128D 1290-12B0 12B2-12B5 12B8-12BE 12C0 12C2-12C5 12C8-12D6 12D8-1310 1312-1315 1318-135A 1380-138F
13A0-13F5 13F8-13FD 1401-166C 166F-167F 1681-169A 16A0-16EA 16EE-16F8 1700-1711 171F-1731 1740-1751 1760-176C 176E-1770 1820-1878 1880-1884 1887-18A8
18AA 18B0-18F5 1900-191E 1A00-1A16 1B05-1B33 1B45-1B4C 1B83-1BA0 1BAE-1BAF 1BBA-1BE5 1C00-1C23 1C4D-1C4F 1C5A-1C7D 1C80-1C8A 1C90-1CBA 1CBD-1CBF
1CE9-1CEC 1CEE-1CF3 1CF5-1CF6 1CFA 1D00-1DBF 1E00-1F15 1F18-1F1D 1F20-1F45 1F48-1F4D 1F50-1F57 1F59 1F5B 1F5D 1F5F-1F7D 1F80-1FB4 1FB6-1FBC 1FBE
1FC2-1FC4 1FC6-1FCC 1FD0-1FD3 1FD6-1FDB 1FE0-1FEC 1FF2-1FF4 1FF6-1FFC 2071 207F 208F-209F 2102 2107 210A-2113 2115 2119-211D 2124 2126 2128 212A-212D
212F-2139 213C-213F 2145-2149 214E 2160-2188 24B6-24E9 2C00-2CE4 2CEB-2CEE 2CF2-2CF3 2D00-2D25 2D27 2D2D 2D30-2D67 2D6F 2D80-2D96 2DA0-2DA6 2DA8-2DAE
2DB0-2DB6 2DB8-2DBE 2DC0-2DC6 2DC8-2DCE 2DD0-2DD6 2DD8-2DDE 2E2F 3005 303B-303C 3105-312F 3131-318E 31A0-31BF A000-A48C A4D0-A4FD A500-A60C A610-A61F
A62A-A62B A640-A66E A67F-A69D A6A0-A6EF A708-A7DD A7E2 A7F1-A801 A803-A805 A807-A80A A80C-A822 A840-A873 A882-A8B3 A8F2-A8F7 A8FB A8FD-A8FE A90A-A925
A930-A946 A960-A97C A984-A9B2 A9CF AA00-AA28 AA40-AA42 AA44-AA4B AAE0-AAEA AAF2-AAF4 AB01-AB06 AB09-AB0E AB11-AB16 AB20-AB26 AB28-AB2E AB30-AB69
AB6C-AB6D AB70-ABE2 AC00-D7A3 D7B0-D7C6 D7CB-D7FB FB00-FB06 FB13-FB17 FB50-FBB1 FBD3-FD3D FD50-FD8F FD92-FDC7 FDF0-FDFB FE70-FE74 FE76-FEFC FF21-FF3A
FF41-FF5A FFA0-FFBE FFC2-FFC7 FFCA-FFCF FFD2-FFD7 FFDA-FFDC 10000-1000B 1000D-10026 10028-1003A 1003C-1003D 1003F-1004D 10050-1005D 10080-100FA
10140-10174 10280-1029C 102A0-102D0 10300-1031F 1032D-1034A 10350-10375 10380-1039D 103A0-103C3 103C8-103CF 103D1-103D5 10400-1049D 104B0-104D3
104D8-104FB 10500-10527 10530-10563 10570-1057A 1057C-1058A 1058C-10592 10594-10595 10597-105A1 105A3-105B1 105B3-105B9 105BB-105BC 105C0-105F3
10600-10736 10740-10755 10760-10767 10780-10785 10787-107B0 107B2-107BF 10800-10805 10808 1080A-10835 10837-10838 1083C 1083F-10855 10860-10876
10880-1089E 108E0-108F2 108F4-108F5 10900-10915 10920-10939 10940-10959 10980-109B7 109BE-109BF 10A00 10A10-10A13 10A15-10A17 10A19-10A35 10A60-10A7C
10A80-10A9C 10AC0-10AC7 10AC9-10AE4 10B00-10B35 10B40-10B55 10B60-10B72 10B80-10B91 10C00-10C48 10C80-10CB2 10CC0-10CF2 10D00-10D23 10D4A-10D65
10D6F-10D85 10E80-10EA9 10EB0-10EB1 10EC2-10EC7 10ED9-10EEE 10F00-10F1C 10F27 10F30-10F45 10F70-10F81 10FB0-10FC4 10FE0-10FF6 11003-11037 11071-11072
11075 11083-110AF 110D0-110E8 11103-11126 11144 11147 11150-11172 11176 11183-111B2 111C1-111C4 111DA 111DC 11200-11211 11213-1122B 1123F-11240
11280-11286 11288 1128A-1128D 1128F-1129D 1129F-112A8 112B0-112DE 11305-1130C 1130F-11310 11313-11328 1132A-11330 11332-11333 11335-11339 1133D 11350
1135D-11361 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11400-11434 11447-1144A 1145F-11461 11480-114AF 114C4-114C5 114C7 11580-115AE
115D8-115DB 11600-1162F 11644 11680-116AA 116B8 11800-1182B 118A0-118DF 118FF-11906 11909 1190C-11913 11915-11916 11918-1192F 1193F 11941 119A0-119A7
119AA-119D0 119E1 119E3 11A00 11A0B-11A32 11A3A 11A50 11A5C-11A89 11A9D 11AB0-11AF8 11B0A 11BC0-11BE0 11C00-11C08 11C0A-11C2E 11C40 11C72-11C8F
11D00-11D06 11D08-11D09 11D0B-11D30 11D46 11D60-11D65 11D67-11D68 11D6A-11D89 11D98 11DB0-11DDB 11DF1 11EE0-11EF2 11F02 11F04-11F10 11F12-11F33 11FB0
12000-12399 12400-1246F 12475-12543 12550-12686 12F90-12FF0 13000-1342F 13441-13446 13460-143FA 14400-14646 16100-1611D 16800-16A38 16A40-16A5E
16A70-16ABE 16AD0-16AED 16B00-16B2F 16B40-16B43 16B63-16B77 16B7D-16B8F 16D40-16D6C 16E40-16E7F 16EA0-16EB8 16EBB-16ED3 16F00-16F4A 16F50 16F93-16F9F
16FE0-16FE1 16FE3 1BC00-1BC6A 1BC70-1BC7C 1BC80-1BC88 1BC90-1BC99 1D400-1D454 1D456-1D49C 1D49E-1D49F 1D4A2 1D4A5-1D4A6 1D4A9-1D4AC 1D4AE-1D4B9 1D4BB
1D4BD-1D4C3 1D4C5-1D505 1D507-1D50A 1D50D-1D514 1D516-1D51C 1D51E-1D539 1D53B-1D53E 1D540-1D544 1D546 1D54A-1D550 1D552-1D6A6 1D6A8-1D6C0 1D6C2-1D6DA
1D6DC-1D6FA 1D6FC-1D714 1D716-1D734 1D736-1D74E 1D750-1D76E 1D770-1D788 1D78A-1D7A8 1D7AA-1D7C2 1D7C4-1D7CB 1DF00-1DF81 1DF90-1DF96 1DFCD-1DFFF
1E030-1E06D 1E100-1E12C 1E137-1E13D 1E14E 1E290-1E2AD 1E2C0-1E2EB 1E4D0-1E4EB 1E5D0-1E5ED 1E5F0 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED
1E6F0-1E6F4 1E6FE-1E6FF 1E7E0-1E7E6 1E7E8-1E7EB 1E7ED-1E7EE 1E7F0-1E7FE 1E800-1E8C4 1E900-1E943 1E94B 1EE00-1EE03 1EE05-1EE1F 1EE21-1EE22 1EE24 1EE27
1EE29-1EE32 1EE34-1EE37 1EE39 1EE3B 1EE42 1EE47 1EE49 1EE4B 1EE4D-1EE4F 1EE51-1EE52 1EE54 1EE57 1EE59 1EE5B 1EE5D 1EE5F 1EE61-1EE62 1EE64 1EE67-1EE6A
1EE6C-1EE72 1EE74-1EE77 1EE79-1EE7C 1EE7E 1EE80-1EE89 1EE8B-1EE9B 1EEA1-1EEA3 1EEA5-1EEA9 1EEAB-1EEBB 1F130-1F149 1F150-1F169 1F170-1F189
"""
HEBREW = """
5D0-5EA 5EF-5F2 FB1D FB1F-FB28 FB2A-FB36 FB38-FB3C FB3E FB40-FB41 FB43-FB44 FB46-FB4F
"""
NUMERIC = """
30-39 600-605 660-669 66B 6DD 6F0-6F9 7C0-7C9 890-891 8E2 966-96F 9E6-9EF A66-A6F AE6-AEF B66-B6F BE6-BEF C66-C6F CE6-CEF D66-D6F DE6-DEF E50-E59
ED0-ED9 F20-F29 1040-1049 1090-1099 17E0-17E9 1810-1819 1946-194F 19D0-19DA 1A80-1A89 1A90-1A99 1B50-1B59 1BB0-1BB9 1C40-1C49 1C50-1C59 A620-A629
A8D0-A8D9 A900-A909 A9D0-A9D9 A9F0-A9F9 AA50-AA59 ABF0-ABF9 FF10-FF19 104A0-104A9 10D30-10D39 10D40-10D49 11066-1106F 110BD 110CD 110F0-110F9
11136-1113F 111D0-111D9 112F0-112F9 11450-11459 114D0-114D9 11650-11659 116C0-116C9 116D0-116E3 11730-11739 118E0-118E9 11950-11959 11BF0-11BF9
11C50-11C59 11D50-11D59 11DA0-11DA9 11DE0-11DE9 11F50-11F59 16130-16139 16A60-16A69 16AC0-16AC9 16B50-16B59 16D70-16D79 1CCF0-1CCF9 1D7CE-1D7FF
1E140-1E149 1E2F0-1E2F9 1E4F0-1E4F9 1E5F1-1E5FA 1E950-1E959 1FBF0-1FBF9
"""
JOINER = """
5F 202F 203F-2040 2054 FE33-FE34 FE4D-FE4F FF3F
"""
KATAKANA = """
3031-3035 309B-309C 30A0-30FA 30FC-30FF 31F0-31FF 32D0-32FE 3300-3357 FF66-FF9D 1AFF0-1AFF3 1AFF5-1AFFB 1AFFD-1AFFE 1B000 1B120-1B122 1B124-1B128
1B155 1B164-1B168
"""
MID_LETTER = """
3A B7 387 55F 5F4 2027 FE13 FE55 FF1A
"""
MID_NUM = """
2C 3B 37E 589 60C-60D 66C 7F8 2044 FE50 FE54 FF0C FF1B
"""
MID_BOTH = """
2E 2018-2019 2024 FE52 FF07 FF0E
"""
EXTEND = """
AD 300-36F 483-489 591-5BD 5BF 5C1-5C2 5C4-5C5 5C7-5C9 610-61A 61C 64B-65F 670 6D6-6DC 6DF-6E4 6E7-6E8 6EA-6ED 711 730-74A 7A6-7B0 7EB-7F3 7FD 816-819
81B-823 825-827 829-82D 859-85B 897-89F 8CA-8E1 8E3-903 93A-93C 93E-94F 951-957 962-963 981-983 9BC 9BE-9C4 9C7-9C8 9CB-9CD 9D7 9E2-9E3 9FE A01-A03
A3C A3E-A42 A47-A48 A4B-A4D A51 A70-A71 A75 A81-A83 ABC ABE-AC5 AC7-AC9 ACB-ACD AE2-AE3 AFA-AFF B01-B03 B3C B3E-B44 B47-B48 B4B-B4D B53-B57 B62-B63
B82 BBE-BC2 BC6-BC8 BCA-BCD BD7 C00-C04 C3C C3E-C44 C46-C48 C4A-C4D C55-C56 C62-C63 C81-C83 CBC CBE-CC4 CC6-CC8 CCA-CCD CD5-CD6 CE2-CE3 CF3 D00-D03
D3B-D3C D3E-D44 D46-D48 D4A-D4D D57 D62-D63 D81-D83 DCA DCF-DD4 DD6 DD8-DDF DF2-DF3 E31 E34-E3A E47-E4E EB1 EB4-EBC EC8-ECE F18-F19 F35 F37 F39
F3E-F3F F71-F84 F86-F87 F8D-F97 F99-FBC FC6 102B-103E 1056-1059 105E-1060 1062-1064 1067-106D 1071-1074 1082-108D 108F 109A-109D 135D-135F 1712-1715
1732-1734 1752-1753 1772-1773 17B4-17D3 17DD 180B-180F 1885-1886 18A9 1920-192B 1930-193B 1A17-1A1B 1A55-1A5E 1A60-1A7C 1A7F 1AB0-1AF0 1B00-1B04
1B34-1B44 1B6B-1B73 1B80-1B82 1BA1-1BAD 1BE6-1BF3 1C24-1C37 1CD0-1CD2 1CD4-1CE8 1CED 1CF4 1CF7-1CF9 1DC0-1DFF 200C-200F 202A-202E 2060-2064 2066-206F
20D0-20F0 2CEF-2CF1 2D7F 2DE0-2DFF 302A-302F 3099-309A A66F-A672 A674-A67D A69E-A69F A6F0-A6F1 A802 A806 A80B A823-A827 A82C A880-A881 A8B4-A8C5
A8E0-A8F1 A8FF A926-A92D A947-A953 A980-A983 A9B3-A9C0 A9E5 AA29-AA36 AA43 AA4C-AA4D AA7B-AA7D AAB0 AAB2-AAB4 AAB7-AAB8 AABE-AABF AAC1 AAEB-AAEF
AAF5-AAF6 ABE3-ABEA ABEC-ABED FB1E FE00-FE0F FE20-FE2F FEFF FF9E-FF9F FFF9-FFFB 101FD 102E0 10376-1037A 10A01-10A03 10A05-10A06 10A0C-10A0F
10A38-10A3A 10A3F 10AE5-10AE6 10D24-10D27 10D69-10D6D 10EAB-10EAC 10ECB-10ECF 10EF0-10EFF 10F46-10F50 10F82-10F85 11000-11002 11038-11046 11070
11073-11074 1107F-11082 110B0-110BA 110C2 11100-11102 11127-11134 11145-11146 11173 11180-11182 111B3-111C0 111C9-111CC 111CE-111CF 1122C-11237 1123E
11241 112DF-112EA 11300-11303 1133B-1133C 1133E-11344 11347-11348 1134B-1134D 11357 11362-11363 11366-1136C 11370-11374 113B8-113C0 113C2 113C5
113C7-113CA 113CC-113D0 113D2 113E1-113E2 11435-11446 1145E 114B0-114C3 115AF-115B5 115B8-115C0 115DC-115DD 11630-11640 116AB-116B7 1171D-1172B
1182C-1183A 11930-11935 11937-11938 1193B-1193E 11940 11942-11943 119D1-119D7 119DA-119E0 119E4 11A01-11A0A 11A33-11A39 11A3B-11A3E 11A47 11A51-11A5B
11A8A-11A99 11B60-11B67 11C2F-11C36 11C38-11C3F 11C92-11CA7 11CA9-11CB6 11D31-11D36 11D3A 11D3C-11D3D 11D3F-11D45 11D47 11D8A-11D8E 11D90-11D91
11D93-11D97 11DF0 11EF3-11EF6 11F00-11F01 11F03 11F34-11F3A 11F3E-11F42 11F5A 13430-13440 13447-13455 1611E-1612F 16AF0-16AF4 16B30-16B36 16F4F
16F51-16F87 16F8F-16F92 16FE4 16FF0-16FF1 1BC9D-1BC9E 1BCA0-1BCA3 1CF00-1CF2D 1CF30-1CF46 1D127-1D128 1D165-1D169 1D16D-1D182 1D185-1D18B 1D1AA-1D1AD
1D242-1D244 1D250-1D252 1D25B-1D25C 1D25F 1D280-1D281 1DA00-1DA36 1DA3B-1DA6C 1DA75 1DA84 1DA9B-1DA9F 1DAA1-1DAAF 1E000-1E006 1E008-1E018 1E01B-1E021
1E023-1E024 1E026-1E02A 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF 1E5EE-1E5EF 1E6E3 1E6E6 1E6EE-1E6EF 1E6F5 1E8D0-1E8D6 1E944-1E94A 1F3FB-1F3FF
E0001 E0020-E007F E0100-E01EF
"""
ALONE = """
B2-B3 B9 BC-BE 9F4-9F9 B72-B77 BF0-BF2 C78-C7E D58-D5E D70-D78 E01-E30 E32-E33 E40-E46 E81-E82 E84 E86-E8A E8C-EA3 EA5 EA7-EB0 EB2-EB3 EBD EC0-EC4 EC6
EDC-EDF F2A-F33 1000-102A 103F 1050-1055 105A-105D 1061 1065-1066 106E-1070 1075-1081 108E 1369-137C 1780-17B3 17D7 17DC 17F0-17F9 1950-196D 1970-1974
1980-19AB 19B0-19C9 1A20-1A54 1AA7 2070 2074-2079 2080-2089 2150-215F 2189 2460-249B 24EA-24FF 2776-2793 2CFD 3006-3007 3021-3029 3038-303A 3041-3096
309D-309F 3192-3195 3220-3229 3248-324F 3251-325F 3280-3289 32B1-32BF 3400-4DBF 4E00-9FFF A830-A835 A9E0-A9E4 A9E6-A9EF A9FA-A9FE AA60-AA76 AA7A
AA7E-AAAF AAB1 AAB5-AAB6 AAB9-AABD AAC0 AAC2 AADB-AADD F900-FA6D FA70-FAD9 10107-10133 10175-10178 1018A-1018B 102E1-102FB 10320-10323 10858-1085F
10879-1087F 108A7-108AF 108FB-108FF 10916-1091B 109BC-109BD 109C0-109CF 109D2-109FF 10A40-10A48 10A7D-10A7E 10A9D-10A9F 10AEB-10AEF 10B58-10B5F
10B78-10B7F 10BA9-10BAF 10CFA-10CFF 10E60-10E7E 10F1D-10F26 10F51-10F54 10FC5-10FCB 11052-11065 111E1-111F4 11700-1171A 1173A-1173B 11740-11746
118EA-118F2 11C5A-11C6C 11FC0-11FD4 16B5B-16B61 16E80-16E96 16FF2-16FF6 17000-18CDA 18CFF-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B001-1B11F 1B123
1B132 1B150-1B152 1B170-1B2FB 1D2C0-1D2D3 1D2E0-1D2F3 1D360-1D378 1E8C7-1E8CF 1EC71-1ECAB 1ECAD-1ECAF 1ECB1-1ECB4 1ED01-1ED2D 1ED2F-1ED3D 1F100-1F10C
20000-2A6DF 2A700-2B81E 2B820-2CEAD 2CEB0-2EBE0 2EBF0-2EE5D 2F800-2FA1D 30000-3134A 31350-33479 3D000-3FC3F
"""
EXTEND_ALNUM = """
345 363-36F 5B0-5BD 5BF 5C1-5C2 5C4-5C5 5C7-5C9 610-61A 64B-657 659-65F 670 6D6-6DC 6E1-6E4 6E7-6E8 6ED 711 730-73F 7A6-7B0 816-817 81B-823 825-827
829-82C 897 8D4-8DF 8E3-8E9 8F0-903 93A-93B 93E-94C 94E-94F 955-957 962-963 981-983 9BE-9C4 9C7-9C8 9CB-9CC 9D7 9E2-9E3 A01-A03 A3E-A42 A47-A48
A4B-A4C A51 A70-A71 A75 A81-A83 ABE-AC5 AC7-AC9 ACB-ACC AE2-AE3 AFA-AFC B01-B03 B3E-B44 B47-B48 B4B-B4C B56-B57 B62-B63 B82 BBE-BC2 BC6-BC8 BCA-BCC
BD7 C00-C04 C3E-C44 C46-C48 C4A-C4C C55-C56 C62-C63 C81-C83 CBE-CC4 CC6-CC8 CCA-CCC CD5-CD6 CE2-CE3 CF3 D00-D03 D3E-D44 D46-D48 D4A-D4C D57 D62-D63
D81-D83 DCF-DD4 DD6 DD8-DDF DF2-DF3 E31 E34-E3A E4D EB1 EB4-EB9 EBB-EBC ECD F71-F83 F8D-F97 F99-FBC 102B-1036 1038 103B-103E 1056-1059 105E-1060
1062-1064 1067-106D 1071-1074 1082-108D 108F 109A-109D 1712-1713 1732-1733 1752-1753 1772-1773 17B6-17C8 1885-1886 18A9 1920-192B 1930-1938 1A17-1A1B
1A55-1A5E 1A61-1A74 1ABF-1AC0 1ACC-1ACE 1B00-1B04 1B35-1B43 1B80-1B82 1BA1-1BA9 1BAC-1BAD 1BE7-1BF1 1C24-1C36 1DD3-1DF4 2DE0-2DFF A674-A67B A69E-A69F
A802 A80B A823-A827 A880-A881 A8B4-A8C3 A8C5 A8FF A926-A92A A947-A952 A980-A983 A9B4-A9BF A9E5 AA29-AA36 AA43 AA4C-AA4D AA7B-AA7D AAB0 AAB2-AAB4
AAB7-AAB8 AABE AAEB-AAEF AAF5 ABE3-ABEA FB1E FF9E-FF9F 10376-1037A 10A01-10A03 10A05-10A06 10A0C-10A0F 10D24-10D27 10D69 10EAB-10EAC 10ECB-10ECD 10EF3
10EF5 10EF7-10EF8 10EFA-10EFC 11000-11002 11038-11045 11073-11074 11080-11082 110B0-110B8 110C2 11100-11102 11127-11132 11145-11146 11180-11182
111B3-111BF 111CE-111CF 1122C-11234 11237 1123E 11241 112DF-112E8 11300-11303 1133E-11344 11347-11348 1134B-1134C 11357 11362-11363 113B8-113C0 113C2
113C5 113C7-113CA 113CC-113CD 11435-11441 11443-11445 114B0-114C1 115AF-115B5 115B8-115BE 115DC-115DD 11630-1163E 11640 116AB-116B5 1171D-1172A
1182C-11838 11930-11935 11937-11938 1193B-1193C 11940 11942 119D1-119D7 119DA-119DF 119E4 11A01-11A0A 11A35-11A39 11A3B-11A3E 11A51-11A5B 11A8A-11A97
11B60-11B67 11C2F-11C36 11C38-11C3E 11C92-11CA7 11CA9-11CB6 11D31-11D36 11D3A 11D3C-11D3D 11D3F-11D41 11D43 11D47 11D8A-11D8E 11D90-11D91 11D93-11D96
11DF0 11EF3-11EF6 11F00-11F01 11F03 11F34-11F3A 11F3E-11F40 1611E-1612E 16F4F 16F51-16F87 16F8F-16F92 16FF0-16FF1 1BC9E 1E000-1E006 1E008-1E018
1E01B-1E021 1E023-1E024 1E026-1E02A 1E08F 1E6E3 1E6E6 1E6EE-1E6EF 1E6F5 1E947
"""
LETTER_ALNUM = """
558 58B-58C 88F C5C CDC 1C89-1C8A 208F 209D-209F 24B6-24E9 A7CB-A7CF A7D2 A7D4 A7DA-A7DD A7E2 A7F1 AB6C-AB6D 105C0-105F3 107BB-107BF 10940-10959
10D40-10D65 10D6F-10D85 10EC2-10EC7 10ED9-10EEE 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 116D0-116E3 11B0A 11BC0-11BE0 11BF0-11BF9
11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 13460-143FA 16100-1611D 16130-16139 16D40-16D6C 16D70-16D79 16EA0-16EB8 16EBB-16ED3
1B124-1B128 1B168 1CCF0-1CCF9 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E5D0-1E5ED 1E5F0-1E5FA 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5
1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 1F130-1F149 1F150-1F169 1F170-1F189
"""
