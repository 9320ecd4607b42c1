"""Public license texts and notices, as their authors publish them; <holder> stands for the names of holders."""

# Whole texts, by SPDX name.
TEXTS = {
    "MIT-text": """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
""",
    "ISC": """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
""",
    "BSD-2-Clause": """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY <holder> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <holder> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
""",
    "BSD-3-Clause": """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name <holder> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
""",
    "Zlib": """
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.
""",
    "Unlicense": """
This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
""",
    "BSL-1.0": """
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
""",
    "Apache-2.0-header": """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.
""",
    "GPL-2.0-or-later": """
This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
""",
    "GPL-3.0-or-later": """
This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
""",
    "AGPL-3.0-or-later": """
This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
""",
    "LGPL-2.1-or-later": """
This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.
""",
    "MPL-2.0-notice": """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.
""",
}

# Titles and sentences by which the whole text of a longer license is known, in the order in which they come.
PASSAGES = {
    "Apache-2.0": ("Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    "GPL-1.0": ("GNU GENERAL PUBLIC LICENSE Version 1, February 1989", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"),
    "GPL-2.0": ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"),
    "GPL-3.0": ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"),
    "LGPL-2.0": ("GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"),
    "LGPL-2.1": ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"),
    "LGPL-3.0": ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"),
    "AGPL-3.0": ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"),
    "GFDL-1.2": ("GNU Free Documentation License Version 1.2, November 2002", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"),
    "GFDL-1.3": ("GNU Free Documentation License Version 1.3, 3 November 2008", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"),
    "MPL-1.1": ("MOZILLA PUBLIC LICENSE Version 1.1",),
    "MPL-2.0": ("Mozilla Public License Version 2.0",),
    "EPL-1.0": ("Eclipse Public License - v 1.0",),
    "EPL-2.0": ("Eclipse Public License - v 2.0",),
    "CDDL-1.0": ("COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0",),
    "EUPL-1.2": ("EUROPEAN UNION PUBLIC LICENCE v", "1.2 EUPL the European Union 2007, 2016"),
    "OFL-1.1": ("SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007",),
    "Artistic-1.0": ("The \"Artistic License\" Preamble",),
    "Artistic-2.0": ("The Artistic License 2.0",),
    "MS-PL": ("Microsoft Public License (Ms-PL)",),
    "PSF-2.0": ("PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2",),
    "WTFPL": ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",),
    "CC0-1.0": ("CC0 1.0 Universal",),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International Public License",),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International Public License",),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International Public License",),
    "CC-BY-ND-4.0": ("Creative Commons Attribution-NoDerivatives 4.0 International Public License",),
    "CC-BY-NC-SA-4.0": ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International Public License",),
    "CC-BY-NC-ND-4.0": ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International Public License",),
    "X11": ("Except as contained in this notice, the name <holder> shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from <holder>",),
    "MIT-0": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",),
    "0BSD": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "PostgreSQL": ("Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",),
    "BSD-4-Clause": ("All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by <holder>",),
    "embedding-exception": ("As an exception, if, as a result of your compiling your source code, portions of this Software are embedded into a machine-executable object form of such source code, you may redistribute such embedded portions in such object form without including the above copyright and permission notices",),
}

# Licenses whose sentences come without another known one between them.
CLOSE = ("BSD-2-Clause", "BSD-3-Clause")

# Sentences that say nothing of a license by themselves; they count only where no license is known.
MARKS = {"All-rights-reserved": ("All rights reserved",)}

# How many of a text's first sentences are enough, where what follows is often left out.
ENOUGH = {"MIT-text": 2, "Apache-2.0-header": 3}

# Notices of one sentence, by the license that they name.
NOTICES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "Licensed under the Apache License 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License", "SPDX-License-Identifier: Apache-2.0"),
    "MIT": ("Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "SPDX-License-Identifier: MIT"),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"),
    "GPL-2.0-only": ("This work is licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0-only"),
    "GPL-3.0-only": ("This work is licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-only"),
    "MPL-2.0": ("Licensed under the Mozilla Public License, version 2.0", "SPDX-License-Identifier: MPL-2.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "This work is licensed under CC BY 4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("This work is dedicated to the public domain under CC0 1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    "Proprietary": ("This software is proprietary and confidential", "Proprietary and confidential", "Unauthorized copying of this file, via any medium, is strictly prohibited"),
}
