"""boxmeter.functions"""
