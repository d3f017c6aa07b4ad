"""Published licence texts and standard headers: how each begins and ends, and digests of the span between.

White space, marks and comment signs between words don't count. The digests were made from licence files as distributed.
"""

#: Words that begin and end a text.
SPANS = [
    ("permission is hereby granted free of charge to any person", "dealings in the software"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "performance of this software"),
    ("redistribution and use in source and binary forms", "possibility of such damage"),
    ("licensed under the apache license version 2 0 the license", "limitations under the license"),
    ("apache license version 2 0 january 2004", "end of terms and conditions"),
    ("gnu general public license version", "end of terms and conditions"),
    ("gnu lesser general public license version 2", "end of terms and conditions"),
    ("gnu library general public license version 2", "end of terms and conditions"),
    ("gnu affero general public license version", "end of terms and conditions"),
    ("gnu lesser general public license version 3", "choose that version for the library"),
    ("is free software you can redistribute it and or modify it under the terms of the gnu", "general public license for more details"),
    ("mozilla public license version 2 0", "secondary licenses as defined by the mozilla public license v 2 0"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla org mpl 2 0"),
    ("eclipse public license v", "waives its rights to a jury trial in any resulting litigation"),
    ("this is free and unencumbered software released into the public domain", "please refer to"),
    ("cc0 1 0 universal", "with respect to this cc0 or use of the work"),
    ("this software is provided as is without any express or implied warranty in no event", "altered from any source distribution"),
]
#: SPDX identifier and SHA-256 of the normalised span.
DIGESTS = [
    ("0BSD", "25a274d52b3014d9bd64e0f3362fd279ac1655f163d5c518f6b9f6c43354802c"),
    ("Apache-2.0", "1f18b9173b944c3929d264c346bf822d7ece67e382710135e5bb7c376446dadb"),
    ("Apache-2.0", "6584323d01f928892ed482cc8d0ab111ed0895aebe0ebda032d2f554717af08b"),
    ("Apache-2.0", "c40235f98e8998f2e4f5fc5131b16fb3c6c5f8ce252d3e6e08daf233725c2073"),
    ("Apache-2.0", "ecb9212d30cbac00f9b55b04b39e843ce5329832c93227612d9a4ab4b48395c9"),
    ("BSD-2-Clause", "2c0ce4f59af71827a45875e557245cbd647da80df4497c9fde2b6d6ce03eb039"),
    ("BSD-2-Clause", "36abc682a39c7cfd3ccb24c35b8e5436d084d3a667429732538384a78389d0f2"),
    ("BSD-2-Clause", "46e8e9d97227f5c0a355566a0415b6f790b5df13e03fdddf2ac75a47584735a9"),
    ("BSD-2-Clause", "6091119410d6d441128c7514a97969723030816ec99a6b3939b6c4dfbe349d7e"),
    ("BSD-2-Clause", "8027774096368556510a578ff4d19ab28b8072aa988cce24dfe85b7afbee8999"),
    ("BSD-2-Clause", "925e3306eb4a5616de812ebe7636c82195825e66ae2e33f8b7f4a9697c78b03b"),
    ("BSD-2-Clause", "9e8e685a22885928da8466dad47189c1cc34d405eeac0f64542df1757d1c78ae"),
    ("BSD-2-Clause", "d3623ad68da379bd154c1e5a8380687879370ba681de73528e97cfd878bcaf83"),
    ("BSD-2-Clause", "e835d4cab37d82b2782bf5a09cc12632e08714f367ecb670b91be8249b235ba6"),
    ("BSD-3-Clause", "01a0d86ababfd1e5fc3c3ac103060e69f63a46bd1820f036ec00f0f9cbedaf28"),
    ("BSD-3-Clause", "07ab062adf3191ad26f8c3b6c9a614f8c0e57bb95204dc596beff105916c1f0f"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("BSD-3-Clause", "24cf4f04ca2fffe4ad075e78b2bf87c212e584b955c2dcdba0b0f61eeea5784b"),
    ("BSD-3-Clause", "33a75a86660c1e3064b04cfa417cce85f213616aa7f7bdb3dc3e20e45a3cc401"),
    ("BSD-3-Clause", "37a50a7818b33e59d1e34ca446972568e2ed619ede9cfc5ce78a50a28e65a444"),
    ("BSD-3-Clause", "39582e400194098a1241eddaa6e384cf9e7d5d0b6aa1fa3be7703db864510ed8"),
    ("BSD-3-Clause", "3aae973a70b86f25b73413b889945faf466546ea8066e6f20bf674ab715d090c"),
    ("BSD-3-Clause", "4cd489b326db62f2bd8c528d41e07f0867e0270178b3120d38b336ab98d51851"),
    ("BSD-3-Clause", "4cd9a86b8073d61f70db7cfb51bbf40987e264873c74247587bc309eb875a5e0"),
    ("BSD-3-Clause", "52322c013b3df7cd46832bdd6bf337107f739fcd18df91938130739fc533a048"),
    ("BSD-3-Clause", "5cfb4090fe07cdab41de25a88543c74565e2df7a884ba690c19c07a0088ee33b"),
    ("BSD-3-Clause", "649ab28d2a8c56085275fd59362e74ec43262bebe6339c3c705222900461a15f"),
    ("BSD-3-Clause", "6f995f44b09dfea6e75a0aae16c1469eebaf673e65063a41744f0fb116469f64"),
    ("BSD-3-Clause", "72d23ea8e41347dacbc89e095daec552716dbfc86c59e01f740e69482ef86a56"),
    ("BSD-3-Clause", "7b3ed99a408897e505234c487b6125474b5efc52881eec4b289e1f966e033827"),
    ("BSD-3-Clause", "80e928d346053a16374bd8965df8b724bde7813286c7acf4e9c041e405fcddc8"),
    ("BSD-3-Clause", "830f2e0364d7a4e29084536a5f2350b3266d902426a5b2c30e881d2d2a61587c"),
    ("BSD-3-Clause", "872969a8de99541e34aeb095ed5b3409cbcb8b77f4be6abda0992bc48b5024f5"),
    ("BSD-3-Clause", "87a27971a68c32151dda12ef5ab55362701b3511f388c5d5b87a3c55a78748fd"),
    ("BSD-3-Clause", "91a489cd1e5bc8c5574aaa498efafd1d475d6c889a29adb3fab0594b6b333f5e"),
    ("BSD-3-Clause", "a330ec743f3904f2d272d882e23730d887e2a85cb92ac21165a0a0449b8d7624"),
    ("BSD-3-Clause", "aa0f1085818278ab34e3ca426d0b75d33b287071962ac536bd179ece03ba775c"),
    ("BSD-3-Clause", "ab899150d08a3ccf837f742a20fbd8dd108031100312f3224aa5e2d14e0d60f1"),
    ("BSD-3-Clause", "b36d0d3b6e6ecb1a226eafeee756db6b5ad07550d21dc48be10a149ba0ae52fa"),
    ("BSD-3-Clause", "be79f7d669852a09aee892a9f75edda15cf738e8697cc89c06719c159d08e23a"),
    ("BSD-3-Clause", "c73cc03562910ebe068ed3b8386095dbd74301f7df0c16b0a6bc89e5406d9ad4"),
    ("BSD-3-Clause", "c7a4a3d85e505797a64a4341bbd48de91a21e67910d618f32762654dc412233f"),
    ("BSD-3-Clause", "e765d5be443e8e2d0a530b57209a0fca2ffdfb94ffb712c03915da4d24ef1644"),
    ("BSD-3-Clause", "f5f2edd859adad8bbc6d9dbd9c911b93d31da6d7e3315a04e75668d06d8a7bb8"),
    ("BSD-3-Clause", "f76c0c2cb42f2a6eca88de7f8cb64217cedfe85ef6de9ea5486034d5878f12b1"),
    ("BSD-3-Clause", "fd3a7538070f09ea712aa4d4aa28d7180ad255bbdcc604177f1859fe1672e08e"),
    ("BSD-4-Clause", "183be2eb65fd28d0f6dd973d72a8825d2874a00feef82cac8299ee974f205ecc"),
    ("BSD-4-Clause", "51e8516432bb78f4bae05159a67c187a86c92d408deb9258163ebab20f6a4494"),
    ("BSD-4-Clause", "b720fa9ae0fc71174e54beffcb98ddc195b76137dd765c157ed77a531aec4c75"),
    ("BSL-1.0", "aea06b6355fa732075f5dcb5df2b6eb112878234413b128f8d74f6f51916a5a2"),
    ("BSL-1.0", "bc846cfb55dfdb9f8fa410db9fe12d713e37178eadb49ec507680484e5ebe2ac"),
    ("CC0-1.0", "7ea83353f6a48443a673f3c4eb58917fd6c45b5b9322ba1c20fbbee6cfc5d526"),
    ("CC0-1.0", "a142ae38742c8c4c35f5fa19e0a40ebfa60fc38535daf9c570ca3d7e012e1e32"),
    ("EPL-1.0", "0a2cb0bcdde4fd19a040ce81ac49166d423c60b78b5b5e6019387edeb4f67285"),
    ("GPL-2.0", "1abc62663f67cb8ac0ca5e794a5642675d40d24fc1e11b162f9f5b54574e0ebb"),
    ("GPL-2.0", "2ce8bd263aa3cf27577c7f3c0e1f0ea82cc606ea85026a8ca97d7fb2a7417a40"),
    ("GPL-2.0", "40093969a0390a12ecc706ae64bfa5f1c1091a4571464f3304f85b5e98f51336"),
    ("GPL-2.0", "693b7e8cc598efbfd57717257bbb30ac7cd7fe42625781c8f841a9459f4fea53"),
    ("GPL-2.0", "f6e795c3b44f4b54f36452627b639c1cf8b6340ed910fd8da03a4700723adc4d"),
    ("GPL-2.0-only", "287aee25d19546633b859a145f333144603135fc2758ec0fd7eae3e31d3ed5fb"),
    ("GPL-2.0-only", "60bc9c408b93174548de7b036f13eb72e6dffc0ec07531e4ec0d551ae407c129"),
    ("GPL-2.0-only", "bb6a30d4eadefe65da0f1dd144b7d98e12861ffa61d3477b275e1528949d24a9"),
    ("GPL-2.0-or-later", "41c658cd106fa7e8b853d4c5bd0bd6f38a94bbf2864c9ce3bcc4e647a7546eb4"),
    ("GPL-2.0-or-later", "492759a0b40d7d1d4f7f1525e5d1bc547cd10ba89b58141089a58998e4e7d90f"),
    ("GPL-2.0-or-later", "4eb7feb07ffd083f66a74e068e399b72cae2c3db7f6b0981233f9b3322878279"),
    ("GPL-2.0-or-later", "90a6c4c0aa1f0e80b1ba3455062d618af1749d774305f1dd4dd6ff7ef944879a"),
    ("GPL-2.0-or-later", "9fad606ce28cf1f68ce8ab0b740fcaca9b568c9afd3cc5de6478a57dd8a9fcd4"),
    ("GPL-2.0-or-later", "a287767ea1d1cfb22f46b1b528377eadd97e610bb1c7cba1773d82092cefcad6"),
    ("GPL-2.0-or-later", "c43d7c9f1e14cfb092734e77677347a404c191f317df27e55a56cd349bfa5f67"),
    ("GPL-2.0-or-later", "d55e70d7bb5a43fa285a94aa69553b21bac9bbe2b2321d00d88c0eeff8178b9e"),
    ("GPL-2.0-or-later", "dbc94035e1e7f907efdb30435237862caaa1e114218501c2a5a6223c83f790ae"),
    ("GPL-2.0-or-later", "e9ab46e5efa9d1ff98facaa44e64a1999be5884c699847511047e2f79e4cf267"),
    ("GPL-2.0-or-later", "f9ada491e24dc653699718c44d73c566be57ca2c781832c6a80b5abea42fdc68"),
    ("GPL-3.0", "efd7bc03c1a34e0d0804015645f5852e30a591eabdfad8d73b153cfe615bc61c"),
    ("GPL-3.0-only", "577e173303419a2cd5002bcd2a1f90d28e18449a00459dbc6ada4b0397db798a"),
    ("GPL-3.0-only", "e349d4ae366a188a8dcdae6dee114af88f137b1eef830415f92b6cc9d7dcad37"),
    ("GPL-3.0-only", "fece4348b71e683289f2403db954ad6589450678d2c154fd0c521b1f326eac06"),
    ("GPL-3.0-or-later", "20796eee43afc5f1567bc9dd128d1e2df1c38c35188c5c3db8fd695b7986d810"),
    ("GPL-3.0-or-later", "2ed5c98711ff5f3668f0fe2fbbb7e59f8a237244b488b77d24e6c0edeb75633e"),
    ("GPL-3.0-or-later", "364c08ce8cce42e43e0442f9fa89168b4b5effb16584a2c47dd2380dfc664115"),
    ("GPL-3.0-or-later", "60db9e876099c961c24e98e5dbae5241396703e9d774858f4dcf9aa636d45d17"),
    ("GPL-3.0-or-later", "62e0f320bdc68b5b51882220a615ef57189bf95d5e04f291d17893ab0294130c"),
    ("GPL-3.0-or-later", "62eb685ad279d0a984a5af97ecfe64fc8932ec2c839a5e22ca8b6e365bd4d741"),
    ("GPL-3.0-or-later", "67de1c16e367fe0036e780bf3759630ad54560495847e088a32258c869d475a0"),
    ("GPL-3.0-or-later", "6d4e55440b71c6fd7396c1d6e28af62d11d54a92d95731bfb24c89f2694209ad"),
    ("GPL-3.0-or-later", "7d0d6b3d2152620fe1adfdc40f6eb1098e97996c3ef700887a83c0cdf0b764c9"),
    ("GPL-3.0-or-later", "7e15480130097a607eeee0d84b45ca7e285bbb15ad0893971d87acdd141d9b04"),
    ("GPL-3.0-or-later", "90e07f3900ae1921765f3fe4d2c1b00f494562b6bcf4c1f0202b14b26285e9be"),
    ("GPL-3.0-or-later", "b629aa5340991ad38d0f98c4b016e2fe4ae73e24716511bca7edc365a75dd529"),
    ("GPL-3.0-or-later", "b82f0d644bb910a0ce60615ebc95160a569b18a43da8e71e7ba5eab054f67aee"),
    ("GPL-3.0-or-later", "cc900e4ccd8eb4b07ccda8c44db835c02fe8c3a98b75655576d0ee4a8ec85b87"),
    ("GPL-3.0-or-later", "d475c7d99c582cda90679bbeb7f76757ed7ded3f04fea826f1843ee386ed9054"),
    ("ISC", "217da0747cec63a2e734185db11cbaa819bcd9e5b83cd12f812128fffe66e26a"),
    ("ISC", "30fe7ddd14f7f6d7bce47da437bac0dc1a88496b90a9be0b1bad8404b114c011"),
    ("ISC", "7bed11ada181e6a63598e2da423080dd990b5647feaf0f67008662a131aec2c7"),
    ("ISC", "b5b951531a352474edea39b1b60c7f6e0def017f2ced90ec4e2d776a7a0fe7d7"),
    ("ISC", "e6c96435b5fbfb15dab0d6a0efc6a1c5858afdce399e83ada3e53afcf1b563e6"),
    ("LGPL-2.0", "853634bf64ffbba86390b39a01a2400adccfca18e67bc321853019d1d4b7f3ce"),
    ("LGPL-2.0-only", "528c9a32fc9dcbf623cadaa74ee46c39c6245280201b9b4e57ff0d6eb72380d0"),
    ("LGPL-2.0-or-later", "437f7ff338009cdbb7e0c6e378564e439cb5615b4705fb868b99fdbe92563600"),
    ("LGPL-2.0-or-later", "55618ac47429de19f69331cb9b2e8899c459bcd5b96ebb23ba9cf25c0edb2363"),
    ("LGPL-2.0-or-later", "66988849311ec36be6057df72d2006830053cc0fa55669b6418b21801aedc4ae"),
    ("LGPL-2.0-or-later", "9406ec4ad51840f13d566d22c4fe4ffde165b447e3a0537f1a2bbc21dc57d9cd"),
    ("LGPL-2.0-or-later", "95e6554613384a9c1d80ed1b36612d6ca0146fcdcaaab94539aa94e259fd4e42"),
    ("LGPL-2.0-or-later", "9ef08394710cddc6d8b8f1daf284abbd215592dff5292cc266e58aba650465b1"),
    ("LGPL-2.0-or-later", "be8429b091f3dbd218d22f75a320c8d429baf7f407387a80631948d24a67dd04"),
    ("LGPL-2.0-or-later", "d7e69701d9bf76011dbff8c35c28d020f3a3bbae9fdc1366be72b906191511d7"),
    ("LGPL-2.0-or-later", "d8936ac0af3697f8db3b9df1f98df4919a856c057e4a5d3910e2695da73a8ba6"),
    ("LGPL-2.1", "06dd0270d355f906ffd654b48f225d1233bbdc5da2c0f80da6f6ccd625e39ebd"),
    ("LGPL-2.1", "2cc76ebcc72476dd26b2857591e687c3f2903731219ba204c372046e5e5e9886"),
    ("LGPL-2.1", "ff57323f588f5f77d29d3c164175364f4f8c8610cf2cf0d7c348c2339f6d0046"),
    ("LGPL-2.1-only", "4570a3645dd639f2c6be91ebd51af5eb72bc3d064c491bb27fb5bb2102ffb938"),
    ("LGPL-2.1-only", "85218b7c54fc0b9dd8c9e32f175f9fcb208f18c206c32954c55bf942515546e1"),
    ("LGPL-2.1-only", "d302d5b5d2d3f17db47bc011685cf6975683f8fbf5ce0b243cb64f34144f0569"),
    ("LGPL-2.1-or-later", "02ae67202fce2d60651b16591472dc7e0a1cbe0ec94005248d1ce30c928a1c5e"),
    ("LGPL-2.1-or-later", "1d41b27de1eb823a61577b63bcf13d7760399d8c6aec6541ea3c0267d975c621"),
    ("LGPL-2.1-or-later", "27fd349f70bef3eb6a927e418468019de5dbabdb5c5ed94eceb4f4ce7a2c1812"),
    ("LGPL-2.1-or-later", "3074c55bb6ad00ad598df8546f36e476c875dde36804d6cafcc07da8fd90dfaf"),
    ("LGPL-2.1-or-later", "45c9e663f49870abdd4f4a3910bc696e2a4c136c72bc3f6f203ae780f03b88dd"),
    ("LGPL-2.1-or-later", "4d3e25e411f3f68535af2bc4b218a09aaea1f17f79c10afa79437e31ec0a1714"),
    ("LGPL-2.1-or-later", "4e70641740c1236862fbdd6abfb1ac2d452b3250be323915c95de6ac6f212c23"),
    ("LGPL-2.1-or-later", "76d4084fc3f8331b9a63e551aa8e2dd4b1b60c76806c7ba6f267e9597fbb6e84"),
    ("LGPL-2.1-or-later", "907e6ca57211119478f17ebbecb5d7a06c59eea243c015b9446801f0c515a2a6"),
    ("LGPL-2.1-or-later", "9369bcdb5c4671b8b8a4ff1040dae60057f9582f63141c5bb97734337e66d869"),
    ("LGPL-2.1-or-later", "96bb42711487c25de23a20b9637931b366f9bde6f55e598bf165f4b488dd3bbb"),
    ("LGPL-2.1-or-later", "b186720bef4cb2ab0e10e6b1d4b21b407e8aa7f53b248b26f310bb0497409b12"),
    ("LGPL-2.1-or-later", "b28aba84359493ada214325ae8e9cb4d01e4d43b3e5739adf8eb22c638a93dec"),
    ("LGPL-2.1-or-later", "cb517bef49f3ebcae3cba32205157683fadfc26642840535610c69f6652390b2"),
    ("LGPL-2.1-or-later", "cbc0374969840f25989953a3ecbed1cb37795f0a703934a48410d68ac4a9a66c"),
    ("LGPL-2.1-or-later", "cc396ab31795ef03048ad2f04136c6117e2e6fb4b1481240e22d084ccf98a3c4"),
    ("LGPL-3.0", "b9fdb0fe94b6e8d8db7635342aeb4f15fd3243cb8f0266243a167e62a434b532"),
    ("LGPL-3.0-only", "7178a671d62baef11d04e830f476aed110699226ceeeb850f87ad494da08aae3"),
    ("LGPL-3.0-only", "953720de407cdb435bb759b5c06890516f21fbbb71fd7ee7b8eb5ff8b4da3bc0"),
    ("LGPL-3.0-or-later", "06a34b864485705f3fbf9219f767224dcca3dff0b90a230fc54d2b420cc8f904"),
    ("LGPL-3.0-or-later", "21eb1335999eec2e282236003d7bd143d87c8262a15fefb85eef2514e6421728"),
    ("LGPL-3.0-or-later", "7be2098918f36e18b198e271b40afb14e990da9244a6972c69c8a161f1b0ca7c"),
    ("LGPL-3.0-or-later", "8ad7354da94b0faaa8a6fcfdfe24fc22444b8f0df12bad22492cccc32221a6de"),
    ("LGPL-3.0-or-later", "98beeb4aac61872ec213ceebe426525d0675b232cf828b8299c17398538a9f87"),
    ("LGPL-3.0-or-later", "b7fad02377a8d27ab15c10257cd597bd954ed7195b81cc37974d7c41501f5ef4"),
    ("LGPL-3.0-or-later", "fbd6b0673860eeefc5ebe02685c17243e5e856b34576fe75335bbdefbdbf872a"),
    ("MIT", "14adafd3ad6d45fa26f6904ed0fb9360d7d4da778e2939ab123c80db4b1ea629"),
    ("MPL-2.0", "1e7e63ab2abc19eba224e040801e9ae27b1aab02c680d66e483e02301921527d"),
    ("MPL-2.0", "23bce6083088171f84835dddb4d2ce5cf3f2a3e06c774396b903a70eabc43b43"),
    ("MPL-2.0", "a7891d5763bc6e48071bd0cff7b7aa922b30c550600350b3ec16485e4e8312a6"),
    ("MPL-2.0", "c6a506eb968bd2cfbb1ea819736390e6ef797bab6d08beb74875c8a0dbc1d917"),
    ("MPL-2.0", "f84ea84d747072c08b473182c3fd7da40af8ab33f6680e618768ee95628c1524"),
    ("Unlicense", "3b8947d3f5bc5df3626ea49494df463cf986300dcd21246ff5d85953a4234ac1"),
    ("Zlib", "1b8c5cd52eceb19ab0bc3cb40be110b1c0e7fa2671a3fe5866e59dd1502e69c7"),
]
